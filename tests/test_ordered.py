"""Chunked operators against plain sequential code, with chunks small enough to matter."""
import math
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.operators import asof as A
from marketlens.operators import bands as B
from marketlens.operators import ordered as O
from marketlens.operators import perf as R
from marketlens.operators import smoothing as S


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out, t = [], {"hot": 0.0, "mid": 0.0, "one": 50.0}
    for i in range(900):
        k = "hot" if i % 3 else "mid"
        t[k] += rng.choice([0, 1, 5, 40, 700])  # ties and gaps wider than a chunk
        out.append((k, i, 1_700_000_000 + t[k], round(rng.uniform(-3, 3), 4), rng.random() < .45))
    out.append(("one", 900, 1_700_000_050.0, -1.5, False))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, i long, s double, pnl double, won boolean").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).cache()


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_running(df, rows):
    x = O.add_chunk(df, "ts", 100)
    got = {r.i: r for r in O.running(x, ["k"], ["ts", "i"], {"s_": ("sum", F.col("pnl")), "m_": ("max", F.col("pnl")), "l_": ("last", F.when(F.col("won"), F.col("i")))}).collect()}
    for rs in by_key(rows).values():
        tot, mx, last = 0.0, -9.0, None
        for r in rs:
            tot, mx, last = tot + r[3], max(mx, r[3]), r[1] if r[4] else last
            g = got[r[1]]
            assert g.s_ == pytest.approx(tot) and g.m_ == mx and g.l_ == last


def test_lookback_frames(df, rows):
    d = O.lookback(df, ["k"], ["ts", "i"], 5, ts="ts", width_s=100, block=7)
    got = {r.i: r.v for r in O.own_rows(d.withColumn("v", F.sum("pnl").over(O.block_window(["k"]).rowsBetween(-5, 0)))).collect()}
    assert len(got) == len(rows)
    for rs in by_key(rows).values():
        for n, r in enumerate(rs):
            assert got[r[1]] == pytest.approx(sum(x[3] for x in rs[max(0, n - 5):n + 1]))


def test_time_halo(df, rows):
    d = O.time_halo(df, "ts", 50, 130).withColumn("t", F.unix_micros("ts"))
    from pyspark.sql import Window
    w = Window.partitionBy("k", O.CHUNK).orderBy("t").rangeBetween(-130_000_000, 0)
    got = {r.i: r.n for r in d.withColumn("n", F.count("*").over(w)).where(O.OWN).collect()}
    for rs in by_key(rows).values():
        for r in rs:
            assert got[r[1]] == sum(1 for x in rs if r[2] - 130 <= x[2] <= r[2])


@pytest.mark.parametrize("width", [100, None])
def test_drawdown_and_streaks(df, rows, width):
    dd = {r.k: r.max_dd for r in R.max_drawdown(df, ["k"], ["ts", "i"], width_s=width).collect()}
    cur = {r.i: r for r in R.equity_curve(df, ["k"], ["ts", "i"], start=10.0, width_s=width).collect()}
    st = {r.i: r.streak for r in R.loss_streak_rows(df, ["k"], ["ts", "i"], width_s=width).collect()}
    tot = {r.k: r for r in R.loss_streaks(df, ["k"], ["ts", "i"], width_s=width).collect()}
    for k, rs in by_key(rows).items():
        eq = pk = worst = 0.0
        run = best = 0
        for r in rs:
            assert cur[r[1]].equity_before == pytest.approx(10 + eq) and cur[r[1]].peak_before == pytest.approx(10 + pk)
            eq += r[3]
            pk = max(pk, eq)
            worst = max(worst, pk - eq)
            run = 0 if r[4] else run + 1
            best = max(best, run)
            assert st[r[1]] == run and cur[r[1]].drawdown == pytest.approx(pk - eq)
        assert dd[k] == pytest.approx(worst) and (tot[k].max_streak, tot[k].current_streak) == (best, run)


@pytest.mark.parametrize("strict,width", [(False, 300), (True, 300), (False, None), (True, None)])
def test_asof_against_merge_asof(spark, df, rows, strict, width):
    rng = random.Random(3)
    left = [(k, n, 1_700_000_000 + rng.uniform(-200, 90_000)) for n, k in enumerate(["hot", "mid", "one", "none"] * 40)]
    left += [(r[0], 1000 + r[1], r[2]) for r in rows[:40]]  # exact hits
    l = spark.createDataFrame(left, "k string, n long, s double").withColumn("at", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    right = df.groupBy("k", "ts").agg(F.max("i").alias("i"))
    for fn, way in ((A.asof_backward, "backward"), (A.asof_forward, "forward")):
        got = {r.n: r.hit for r in fn(l, right, ["k"], left_ts="at", right_ts="ts", take={"hit": "i"}, width_s=width, strict=strict).collect()}
        pr = right.toPandas().sort_values("ts")
        pl = l.select("k", "n", "at").toPandas().sort_values("at")
        want = pd.merge_asof(pl, pr, left_on="at", right_on="ts", by="k", direction=way, allow_exact_matches=not strict)
        assert got == {int(a): (None if pd.isna(b) else int(b)) for a, b in zip(want["n"], want["i"])}


@pytest.mark.parametrize("width", [None, 300])
def test_asof_many_equals_one_by_one(spark, df, rows, width):
    """Three sources of different columns, one with a tolerance; hot key, rows without a key or a time, repeated left rows."""
    rng = random.Random(4)
    left = [(k, n, 1_700_000_000 + rng.uniform(-200, 90_000)) for n, k in enumerate(["hot", "mid", "one", "none"] * 40)]
    left += [(r[0], 1000 + r[1], r[2]) for r in rows[:40]] + [(None, 5000, 1_700_000_500.0), ("hot", 5001, None), ("hot", 5002, 1_700_000_500.0), ("hot", 5002, 1_700_000_500.0)]
    l = spark.createDataFrame(left, "k string, n long, s double").withColumn("at", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    sides = [df.groupBy("k", "ts").agg(F.max("i").alias("i")), df.where("i % 7 = 0").groupBy("k", "ts").agg(F.max("pnl").alias("pnl")), df.where("i % 11 = 0").select("k", "ts", "i", "won")]
    sides[0] = sides[0].unionByName(spark.createDataFrame([(None, None, 1), ("hot", None, 2)], "k string, ts timestamp, i long"))
    got = A.asof_many(l, [A.Source(sides[0], "ts", {"a": "i"}), A.Source(sides[1], "ts", {"b": "pnl"}, tolerance_s=30), A.Source(sides[2], "ts", {"c": "won", "at_i": "i"}, tie=["i"])], ["k"], left_ts="at", width_s=width)
    one = A.asof_backward(l, sides[0], ["k"], left_ts="at", right_ts="ts", take={"a": "i"})
    one = A.asof_backward(one, sides[1], ["k"], left_ts="at", right_ts="ts", take={"b": "pnl"}, tolerance_s=30)
    one = A.asof_backward(one, sides[2], ["k"], left_ts="at", right_ts="ts", take={"c": "won", "at_i": "i"}, right_tie=["i"])
    want = sorted(map(str, one.collect()))
    assert sorted(map(str, got.collect())) == want and len(want) == 204


def test_asof_many_orders_once(spark, df):
    l = df.select("k", F.col("ts").alias("at"))
    x = A.asof_many(l, [A.Source(df, "ts", {f"c{n}": "i"}, tie=["i"]) for n in range(5)], ["k"], left_ts="at", width_s=300)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 4, plan  # rows of all sides, chunk rows, and the join of both


def test_asof_tolerance_and_no_key(spark, df):
    l = spark.createDataFrame([(1, 1_700_000_000.0), (2, 1_799_000_000.0)], "n long, s double").withColumn("at", F.timestamp_seconds("s"))
    got = {r.n: r.hit for r in A.asof_backward(l, df.groupBy("ts").agg(F.max("i").alias("i")), [], left_ts="at", right_ts="ts", take={"hit": "i"}, tolerance_s=60).collect()}
    assert got[2] is None


def test_trailing_sums_match_a_scan(spark, df, rows):
    """Chunks narrower and wider than the window, a null value, ties; nothing is left over where all rows have gone."""
    from marketlens.operators.features import trailing_sums

    x = df.withColumn("v", F.when(F.col("i") % 5 > 0, F.col("pnl") / 3))
    for width in (70, 5000):
        got = {r.i: (r.s, r.n) for r in trailing_sums(x, 130, {"s": F.col("v"), "n": F.lit(1)}, keys=["k"], ts="ts", width_s=width).collect()}
        assert len(got) == len(rows)
        for rs in by_key(rows).values():
            for r in rs:
                near = [q for q in rs if r[2] - 130 <= q[2] <= r[2]]
                own = [q[3] / 3 for q in near if q[1] % 5 > 0]
                assert got[r[1]] == (pytest.approx(sum(own), abs=1e-8), len(near)) and (own or got[r[1]][0] == 0.0)


def test_time_ema_matches_loop(df, rows):
    got = {r.i: r.ema for r in S.time_ema(df.withColumn("price", F.col("pnl") + 10), 3.0, keys=["k"], tie=["i"]).collect()}
    for rs in by_key(rows).values():
        x = last = None
        for r in rs:
            x = r[3] + 10 if x is None else x + (1 - math.exp(-(r[2] - last) / 3.0)) * (r[3] + 10 - x)
            last = r[2]
            assert got[r[1]] == pytest.approx(x, rel=1e-11)


@pytest.mark.parametrize("alpha,seed,width", [(0.5, None, 100), (0.9, 0.25, 100), (0.5, None, None)])
def test_row_ema_matches_loop(df, rows, alpha, seed, width):
    got = {r.i: r.ema for r in S.row_ema(df, alpha, keys=["k"], order=["ts", "i"], value="pnl", seed=seed, width_s=width).collect()}
    for rs in by_key(rows).values():
        x = seed
        for r in rs:
            x = r[3] if x is None else (1 - alpha) * x + alpha * r[3]
            assert got[r[1]] == pytest.approx(x, rel=1e-10, abs=1e-12)


def test_calibration_emas_index_once(df, rows, monkeypatch):
    """Both averages equal a loop, and their rows are ordered once."""
    d = df.withColumn("p", F.abs("pnl") / 3)
    real, calls = S.dense_index, []
    monkeypatch.setattr(S, "dense_index", lambda *a, **k: calls.append(1) or real(*a, **k))
    got = {r.i: r for r in S.calibration_emas(d, keys=["k"], order=["ts", "i"]).collect()}
    assert len(calls) == 1
    for rs in by_key(rows).values():
        e, h = 0.25, 1.0
        for r in rs:
            p = abs(r[3]) / 3
            e, h = e * .96 + (p - r[4]) ** 2 * .04, h * .97 + (0.6 + 0.8 * ((p >= .5) == r[4])) * .03
            assert (got[r[1]].cal_err_ema, got[r[1]].reliability) == (pytest.approx(e, rel=1e-9), pytest.approx(h, rel=1e-9))


def test_kalman_blocks_match_one_scan(df, rows):
    x = df.groupBy("k", "ts").agg(F.max(F.col("pnl") + 100).alias("price")).withColumn("vol", F.lit(.7))
    a = {(r.k, r.ts): (r.pos, r.vel) for r in S.kalman_velocity(x, keys=["k"], width_s=100, halo=60, block=64).collect()}
    b = {(r.k, r.ts): (r.pos, r.vel) for r in S.kalman_velocity(x, keys=["k"], width_s=1e9, halo=60, block=100_000).collect()}
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], rel=1e-6, abs=1e-6) for k in a)


@pytest.mark.parametrize("n", [1, 2, 5, 6, 18, 19, 20, 57])
def test_exclusive_quantile(spark, n):
    rng = random.Random(n)
    xs = [float(rng.randint(0, 900)) for _ in range(n)]
    got = R.exclusive_quantile(spark.createDataFrame([("e", x) for x in xs], "e string, x double"), ["e"], "x", bin_width=50).first()
    want = xs[0] if n == 1 else statistics.quantiles(xs, n=20)[18]
    assert got.q == pytest.approx(want) and got.n == n


def test_band_scan_brute_force(spark):
    rng = random.Random(5)
    xs = [(f"m{i}", 1_700_000_000 + rng.randint(0, 4000), rng.choice([.08, .1, .12, .4, round(rng.uniform(.05, .45), 4)]), rng.random() < .3) for i in range(400)]
    d = spark.createDataFrame(xs, "slug string, s long, p_low double, low_won boolean").withColumn("end_ts", F.timestamp_seconds("s"))
    grid = B.price_grid(.08, .40, .04)
    got = {(r.lo, r.hi): r for r in B.band_profit_scan(d, grid=grid, width_s=300, min_n=5).collect()}
    seq = sorted(xs, key=lambda x: (x[1], x[0]))
    n_want = 0
    for a in range(len(grid)):
        for b in range(a + 1, len(grid)):
            sub = [x for x in seq if grid[a] <= x[2] < grid[b]]
            gl = sum(.99 for x in sub if not x[3])
            if len(sub) < 5 or not gl:
                assert (grid[a], grid[b]) not in got
                continue
            n_want += 1
            run = best = 0
            for x in sub:
                run = 0 if x[3] else run + 1
                best = max(best, run)
            r = got[(grid[a], grid[b])]
            assert (r.n, r.wins, r.max_loss_streak) == (len(sub), sum(x[3] for x in sub), best)
            assert r.pf == pytest.approx(sum(.99 * (1 / x[2] - 1) for x in sub if x[3]) / gl)
    assert len(got) == n_want


def test_grid_has_65_points():
    assert len(B.price_grid()) == 65
