from tests.llm.helpers import collected, docs
from tests.llm.test_toxicity import labels
from timeweave.llm.toxicity import learn, score_documents


def test_spaced_texts_and_long_tokens(spark):
    """Runs of several words, a word of one letter before them and tokens beyond 40 characters are decoded."""
    clean = "the quick brown fox jumps over a lazy dog and runs along the river"
    rows = [(i, f"{clean} you scum and i call loser number{i}x" if i % 4 == 0 else f"{clean} you and i call number{i}x") for i in range(400)]
    spaced = lambda text: " ".join(text.replace(" ", ""))
    toxic = [(1000, spaced("you scum loser")), (1001, spaced("i loser and scum")), (1002, "you.scum.5cum.and.l0ser.over.the.l4zy.dog.and.the.river"), (1003, f"{clean} l{'o' * 60}ser 5{'c' * 50}um"), (1004, f"{clean} {'-'.join('you5cumandl0serscum')}-{'-'.join('alongtheriver')}")]
    fine = [(1100, spaced(clean)), (1101, "the.qu1ck.brown.f0x.jumps.over.a.lazy.dog.and.runs"), (1102, " ".join(clean for _ in range(300)))]
    df = docs(spark, rows + toxic + fine)
    got = collected(score_documents(df, learn(df, labels(spark, [(i, int(i % 4 == 0)) for i in range(400)]))))
    assert [got[k].predicted for k, _ in toxic] == [1] * len(toxic)
    assert [got[k].predicted for k, _ in fine] == [0] * len(fine)
