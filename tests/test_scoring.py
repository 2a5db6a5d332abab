"""Scoring steps: a filter on a late column stays where it stands."""
from pyspark.sql import functions as F

from marketlens.plans import scoring as S
from workloads import scoring_q as Q



def test_steps_are_plain_projections(spark):
    """No step packs its row into an array and unpacks it again."""
    row = {n: F.expr(t) for n, t in Q.SNAPSHOT.items()}
    lines = spark.range(200).select(F.col("id").alias("l_orderkey"), (F.col("id") * 7).alias("l_partkey"), (F.col("id") * 3).alias("l_suppkey"),
                                    (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), F.col("id").cast("double").alias("l_quantity"))
    sized = S.entry_and_size(S.copy_adjust(S.choose_side(S.llr_posterior(S.score_sheet(S.direction(lines.withColumns(row)))))))
    assert "Generate" not in sized._jdf.queryExecution().optimizedPlan().toString()
    rows = sized.select("l_orderkey", "entry", "score", "side", "size_reason").collect()
    for cond, keep in (("size_reason = 'ok'", lambda r: r.size_reason == "ok"), ("entry IS NOT NULL", lambda r: r.entry is not None),
                       ("score >= 5", lambda r: r.score >= 5), ("side = 'Up'", lambda r: r.side == "Up")):
        late = sized.where(cond)
        plan = late._jdf.queryExecution().optimizedPlan().toString()
        assert len([x for x in plan.split("\n") if "Filter" in x][0]) < 200, cond  # not the steps before, copied
        assert {r.l_orderkey for r in late.select("l_orderkey").collect()} == {r.l_orderkey for r in rows if keep(r)}


def test_score_sheet_query_scores_every_row_in_compiled_projections(spark, tmp_path):
    """Nothing is packed and unpacked, the loop limit is applied by the query itself, and null or repeated keys keep their rows."""
    rows = [(k, k * 7 % 90, k * 3 % 40, k % 7 + 1, float(k % 50)) for k in range(300)] + [(5, 35, 15, 6, 5.0)] * 3 + [(None, 35, 15, 6, 5.0), (5, None, None, 6, None)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    sheet = Q.REGISTERED["score_sheet"][0](spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000  # the JVM compiles no longer method
    assert "Generate" not in sheet._jdf.queryExecution().optimizedPlan().toString()
    out = sheet.collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r[c] for c in Q.LINE_COLS) for r in out), key=key) == sorted(((o, n, p, s) for o, p, s, n, _ in rows), key=key)
    assert all(r["score"] == sum(r[f"pts_{k}"] for k in S.SHEET) for r in out)
