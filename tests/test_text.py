import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as tx


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr.alias("r")).first()["r"]


def test_clean_text_golden(spark):
    sw = ["don", "t", "use", "in"]
    got = one(spark, tx.clean_text(F.col("v"), sw), "Don't use GPT_4 in 2023: naïve ½ x² models")
    assert got == "gpt naïve x² models"


def test_clean_text_null_and_stopwords_only(spark):
    assert one(spark, tx.clean_text(F.col("v")), None) == ""
    assert one(spark, tx.clean_text(F.col("v")), "of the and") == ""


def test_clean_is_idempotent(spark):
    v = "Héllo, wörld!! 42 co-operate x² ½ the"
    once = one(spark, tx.clean_text(F.col("v")), v)
    assert one(spark, tx.clean_text(F.col("v")), once) == once


def _py_tokens(s):
    return re.sub(r"[\W_]+", " ", s).lower().split()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZé_ -.,'²½3ß\nİ9xç")), max_size=40))
def test_word_tokens_match_python(spark, s):
    assert one(spark, tx.word_tokens(F.col("v")), s) == _py_tokens(s)


def test_numeric_tokens_dropped(spark):
    got = one(spark, tx.clean_tokens(F.col("v"), []), "2023 abc 12b ² x² ½")
    assert got == ["abc", "12b", "x²"]


def test_repair_key_goldens(spark):
    for raw, want in [("0_ Title", "0_Title"), ("0_Title", "0_Title"), ("10_ A_ B", "10_A_ B")]:
        assert one(spark, tx.repair_key(F.col("v")), raw) == want


def test_derive_pdf_url_golden(spark):
    url = "https://proceedings.mlr.press/v208/zecevic23a.html"
    assert one(spark, tx.derive_pdf_url(F.col("v")), url) == \
        "https://proceedings.mlr.press/v208/zecevic23a/zecevic23a.pdf"


def test_title_key_and_paper_key(spark):
    df = spark.createDataFrame([(3, "A = {b}: \"c\" d")], "pos int, t string")
    assert df.select(tx.paper_key(F.col("pos"), "t")).first()[0] == "3_A  b c d"


def test_extract_year(spark):
    assert one(spark, tx.extract_year(F.col("v")), "AAAI 2023 and 1999") == 2023
    assert one(spark, tx.extract_year(F.col("v")), "x12023 no") is None


def test_human_bytes(spark):
    said = [(0, " 0.0 B"), (1, " 1.0 B"), (1023, "1023.0 B"), (1024, " 1.0 KB"), (1536, " 1.5 KB"), (575930368, "549.2 MB"),
            (3221225477, " 3.0 GB"), (2199023255552, "2.0 PB"), (10 ** 16, "9094.9 PB")]
    df = spark.createDataFrame(said, "v long, want string")
    assert [(r.v, r.got) for r in df.select("v", tx.human_bytes("v").alias("got")).collect()] == said


def test_human_duration_integral(spark):
    said = [(0, "0.000s"), (59, "59.000s"), (60, "60.000s"), (61, "1.017m"), (233, "3.883m"), (3600, "60.000m"), (3601, "1.000h"), (82199, "22.833h")]
    df = spark.createDataFrame(said, "v long, want string")
    assert [(r.v, r.got) for r in df.select("v", tx.human_duration("v", integral=True).alias("got")).collect()] == said


def test_search_name(spark):
    df = spark.createDataFrame([("Causal  Effect estimation ",)], "q string")
    got = df.select(tx.search_name(F.lit("Cosine"), F.lit("abstract"), F.col("q"))).first()[0]
    assert got == "cosine_abstract_causal-effect-estimation"


def test_numeric_string(spark):
    vals = ["1", "1.5", "-2e3", ".5", "abc", "1_000", "nan", " 7 ", ""]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(tx.is_numeric_string("v")).collect()]

    def py(s):
        try:
            float(s.replace("_", "x"))
            return True
        except ValueError:
            return False
    assert got == [py(v) for v in vals]
