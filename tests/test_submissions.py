"""Submission checks fold case as the rules state it."""

from pyspark.sql import functions as F

from ridgeline.functions import text
from ridgeline.plans import catalog


def test_casefold_of_all_characters(spark):
    plain = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    rows = [("".join(plain[i : i + 997]),) for i in range(0, len(plain), 997)]
    rows += [("Straße\nGROẞ",), ("ΟΔΟΣ ς",), ("ß",), ("",), (None,), ("ßß a ŉb",)]
    got = spark.createDataFrame(rows, "x string").select("x", text.casefold(F.col("x")).alias("y")).collect()
    assert len(got) == len(rows) and all(r.y == (None if r.x is None else r.x.casefold()) for r in got)


def test_against_sql_where_case_changes_length(spark, tmp_path):
    """Upper case of the first characters of these texts is not undone by lower case."""
    import duckdb

    begins = ["Erß der", "ßßßß", "ŉ was", "ﬁne ﬂow", "οδος ος", "ας ας", "İzmir", "ǰ ΐ ΰ", "ᾳ ῃ ῳ", "Ꭰꭰ Ꭱ", "ẞ ß", "plain"]
    rows = [(32 * i + k, 0, "user", b + " and more") for i, b in enumerate(begins) for k in (0, 2, 19, 24)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["submission_checks"]).fetchall()
    got = catalog.queries()["submission_checks"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 3 * len(begins)


def test_claims_in_any_case_are_literal(spark):
    """M24 compares folded texts: STRASSE is the literal text of Straße, Strasze is not."""
    from ridgeline.operators import submissions

    said = spark.createDataFrame([("G", "u", 0.0, 1.0, "Straße")], "graph_id string, utterance_id string, start double, end double, text string")
    packets = spark.createDataFrame([("S", "G")], "submission_id string, graph_id string")
    claims = spark.createDataFrame([("S", i, "u", "reported_claim", t, False) for i, t in (("a", "STRASSE"), ("b", "Strasze"))], "submission_id string, claim_id string, source_utterance string, kind string, text string, world_fact boolean")
    s = submissions.Submissions(packets=packets, bundles=None, bindings=None, reviews=None, claims=claims)
    g = submissions.Graph(audio=None, utterances=said, instances=None, media=None, facts=None)
    assert [(r.rule, r.subject) for r in submissions.claim_violations(s, g).collect()] == [("M24", "b")]
