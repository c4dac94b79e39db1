from tests.llm.helpers import collected, docs
from timeweave.llm.secret_scan import redact, secret_scan


def test_one_owners_key_is_live_in_any_number_of_documents(spark):
    own, shared = "AKIA" + "O" * 16, "AKIA" + "S" * 16
    rows = [(i, f"page {i} has {own}", None, "me") for i in range(40)] + [(100 + i, f"see {shared}", None, f"owner{i}") for i in range(2)]
    df = docs(spark, rows)
    got = collected(secret_scan(df))
    assert all((got[i].n_live, got[i].n_copied) == (1, 0) for i in range(40))
    assert all((got[i].n_live, got[i].n_copied) == (0, 1) for i in (100, 101))
    out = collected(redact(df))
    assert all(out[i].text == f"page {i} has [SECRET]" for i in range(40)) and out[100].text == f"see {shared}"
