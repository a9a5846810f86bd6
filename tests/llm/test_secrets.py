from podium.llm import secret_scan

from . import cases


def test_values_after_names_in_any_form(spark):
    key = "9f8e7d6c5b4a3210"
    named = [(f"api_key={key}", key), (f"see https://x.org/a?id=3&token={key}&n=1 there", key), (f"export X=AWS_SECRET_ACCESS_KEY={key}AB", f"{key}AB"),
             (f"lib/path/token={key}", key), ("password: p@ss!word", "p@ss!word"), ("pwd = \"correct-horse(battery)\"", "correct-horse(battery)"), ("API_KEY=abcdefghijkl", "abcdefghijkl"),
             ("secret='abc1234'", "abc1234"), (f"\"s3_access_key\": \"{key}\"", key), (f"token => {key}", key)]
    other = [(f"checksum={key}", key), ("QWxhZGRpbjpvcGVuIHNlc2FtZQ1==", "QWxhZGRpbjpvcGVuIHNlc2FtZQ1=="), (f"a=b={key}", key)]
    texts = [t for t, _ in named + other] + ["the author: somebody", "a password of many words", "name=abcdefghijkl"]
    found = secret_scan.provisional_labels(secret_scan.candidates(cases.table(spark, texts)))
    got = sorted((r["doc_id"], r["start"], r["value"], r["label"]) for r in found.collect())
    assert got == [(i, t.index(v), v, i < len(named)) for i, (t, v) in enumerate(named + other)]
