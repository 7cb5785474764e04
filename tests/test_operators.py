"""Hand cases and metamorphic properties of the operators."""

import datetime as dt
import difflib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import parsers, stats
from tessella.functions import scalars as S
from tessella.operators import combiner, cross_section, events, features, fundamentals, governance, graph, looks, options, pit, portfolio, quality, text, ticks
from tessella.plans import text_graph_queries
from tessella.sources import readers
from tessella.streaming import twins

D = lambda s: dt.date.fromisoformat(s)
DAYS = [d.date() for d in pd.bdate_range("2020-01-06", periods=300)]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


class TestAsof:
    def pair(self, spark, right):
        left = spark.createDataFrame([("A", D("2020-01-10")), ("A", D("2020-01-13")), ("B", D("2020-01-10"))], "k string, t date")
        return left, spark.createDataFrame([("A", D(d), v) for d, v in right], "k string, d date, v double")

    def test_lag_boundary(self, spark):
        left, right = self.pair(spark, [("2020-01-10", 1.0)])
        got = {(r.k, r.t.day): r.v for r in pit.asof_backward(left, right, "k", "t", "d", ["v"], lag_days=1).collect()}
        assert got == {("A", 10): None, ("A", 13): 1.0, ("B", 10): None}
        got = {(r.k, r.t.day): r.v for r in pit.asof_backward(left, right, "k", "t", "d", ["v"]).collect()}
        assert got[("A", 10)] == 1.0

    def test_null_blanks_or_not(self, spark):
        left, right = self.pair(spark, [("2020-01-05", 1.0), ("2020-01-07", None)])
        carry = pit.asof_backward(left, right, "k", "t", "d", ["v"]).where("k = 'A'")
        skip = pit.asof_backward(left, right, "k", "t", "d", ["v"], carry_nulls=False).where("k = 'A'")
        assert {r.v for r in carry.collect()} == {None} and {r.v for r in skip.collect()} == {1.0}

    def test_nearest_tie_goes_back(self, spark):
        left, right = self.pair(spark, [("2020-01-08", 1.0), ("2020-01-12", 2.0)])
        got = {(r.k, r.t.day): r.v for r in pit.asof_nearest(left, right, "k", "t", "d", ["v"], 2).collect()}
        assert got == {("A", 10): 1.0, ("A", 13): 2.0, ("B", 10): None}

    def test_future_rows_change_nothing(self, spark):
        r = random.Random(1)
        ev = [("A", D("2020-01-01") + dt.timedelta(r.randrange(200)), D("2019-01-01") + dt.timedelta(r.randrange(400)), float(i)) for i in range(60)]
        cut = D("2020-05-01")
        def run(e):
            df = spark.createDataFrame(r.sample(e, len(e)), "k string, avail date, period date, v double")
            return [x for x in rows(pit.as_of_states(df.groupBy("k", "avail", "period").agg(F.max("v").alias("v")), "k", "avail", "period")) if x[1] <= cut]
        assert run(ev) == run([e for e in ev if e[1] <= cut])


def test_first_filed_and_states(spark):
    f = spark.createDataFrame([("c", 1, D("2020-03-01"), "b", 2.0), ("c", 1, D("2020-02-01"), "z", 1.0), ("c", 1, D("2020-02-01"), "a", 3.0)], "cik string, q int, filed date, adsh string, v double")
    assert rows(pit.first_filed(f, ["cik", "q"], ["filed", "adsh"]), "v") == [(3.0,)]
    e = spark.createDataFrame([("c", D("2020-02-01"), D("2019-12-31"), 1.0), ("c", D("2020-03-01"), D("2019-09-30"), 2.0), ("c", D("2020-03-01"), D("2020-01-31"), 3.0)], "k string, a date, p date, v double")
    assert rows(pit.as_of_states(e, "k", "a", "p"), "v") == [(1.0,), (3.0,)]


def test_membership_spells(spark):
    s = spark.createDataFrame([(D("2020-01-01"), "A"), (D("2020-01-01"), "B"), (D("2020-02-01"), "A"), (D("2020-03-01"), "A"), (D("2020-03-01"), "B")], "date date, ticker string")
    got = rows(pit.membership_intervals(s), "ticker", "valid_from", "valid_to")
    assert got == [("A", D("2020-01-01"), D("2020-04-30")), ("B", D("2020-01-01"), D("2020-01-31")), ("B", D("2020-03-01"), D("2020-04-30"))]


def test_band_match_takes_the_oldest_of_a_tie(spark):
    q = spark.createDataFrame([("c", D("2018-12-22"), 1.0), ("c", D("2019-01-11"), 2.0), ("c", D("2020-01-01"), 5.0)], "cik string, ddate date, value double")
    m = pit.band_self_match(q, "cik", "ddate", "value", 365, 45).collect()
    assert [(r.prior_date, r.prior_value) for r in m if r.ddate == D("2020-01-01")] == [(D("2019-01-11"), 2.0)] or abs((D("2020-01-01") - D("2018-12-22")).days - 365) == 10


def test_full_windows_only(spark):
    b = spark.createDataFrame([("A", d, 100 * 1.01**i, float(i + 1)) for i, d in enumerate(DAYS[:70])], "ticker string, date date, close double, volume double")
    out = {r.date: r for r in features.risk(features.momentum(b)).collect()}
    first = min(d for d in out if out[d].volatility_21d is not None)
    assert first == DAYS[21] and out[DAYS[21]].momentum_21d == pytest.approx(1.01**21 - 1) and out[DAYS[20]].momentum_21d is None
    assert min(d for d in out if out[d].volume_zscore is not None) == DAYS[62]


class TestBook:
    def case(self, spark):
        px = {"A": [100, 110, 121], "B": [100, 100, 100], "C": [100, 95, 95], "D": [100, 90, 81]}
        prices = spark.createDataFrame([(t, DAYS[i], float(v)) for t, x in px.items() for i, v in enumerate(x)], "ticker string, date date, close double")
        sig = [{"A": 4, "B": 3, "C": 2, "D": 1}, {"A": 4, "C": 3, "B": 2, "D": 1}, {"A": 4, "C": 3, "B": 2, "D": 1}]
        s = spark.createDataFrame([(DAYS[i], t, float(v)) for i, g in enumerate(sig) for t, v in g.items()], "date date, ticker string, score double")
        return prices, cross_section.equal_weight_legs(s, q=2, cap=0.5)

    def test_four_names_by_hand(self, spark):
        prices, targets = self.case(spark)
        out = portfolio.share_book(prices, targets, portfolio.Costs(10.0, 5.0, 0.0)).orderBy("date").toPandas()
        np.testing.assert_allclose(out["gross"], [0, 0.125, 0.1], atol=1e-12)
        np.testing.assert_allclose(out["turnover"], [1, 89 / 90, 0], atol=1e-12)
        np.testing.assert_allclose(out["trading_cost"], [0.003, 178 / 90 * 0.0015, 0], atol=1e-12)
        np.testing.assert_allclose(out["long"], [0, 0.05, 0.05], atol=1e-12)
        np.testing.assert_allclose(out["short"], [0, 0.075, 0.05], atol=1e-12)

    def test_ended_prices_turn_to_cash(self, spark):
        prices, targets = self.case(spark)
        prices = prices.where("not (ticker = 'D' and date = date'2020-01-08')")
        out = portfolio.share_book(prices, targets, portfolio.Costs(0, 0, 0.0)).orderBy("date").toPandas()
        assert out["gross"].iloc[2] == pytest.approx(0.05) and out["names"].tolist() == [4, 4, 3]

    def test_next_open(self, spark):
        prices = spark.createDataFrame([("A", DAYS[i], c, o) for i, (c, o) in enumerate([(10.0, 10.0), (12.0, 11.0), (12.0, 12.0)])] + [("B", DAYS[i], 10.0, 10.0) for i in range(3)], "ticker string, date date, close double, open double")
        targets = spark.createDataFrame([(DAYS[0], "A", 0.5), (DAYS[0], "B", -0.5)], "date date, ticker string, weight double")
        out = portfolio.share_book(prices, targets, portfolio.Costs(0, 0, 0.0), "next_open").orderBy("date").toPandas()
        np.testing.assert_allclose(out["gross"], [0.5 / 11, 0], atol=1e-12)

    @pytest.mark.parametrize("execution", ["close", "next_open"])
    def test_book_day_by_day(self, spark, execution):
        """one task held all prices. Gaps, ended names, repeated targets and a value below nothing, against a plain loop."""
        r, at_open, calendar = random.Random(5), execution == "next_open", DAYS[:30]
        px = {(n, i): (100 * r.uniform(0.5, 1.6), 100 * r.uniform(0.5, 1.6)) for n in "ABCDEF" for i in range(r.choice([30, 30, 14])) if r.random() < 0.8}
        wish, last = {}, None
        for i in sorted(r.sample(range(30), 9)):
            wish[i] = last = last if last and r.random() < 0.4 else {n: r.choice([-3.0, -1.0, 0.5, 2.0]) for n in r.sample("ABCDEF", 4)}
        days = sorted({i for _, i in px} | set(wish))
        final = {n: max(i for m, i in px if m == n) for n in "ABCDEF"}
        nav, shares, done, close, want = 1.0, {}, None, {}, []
        for k, i in enumerate(days):
            before, gain, traded = nav, {1: 0.0, -1: 0.0}, 0.0
            lent = -sum(min(shares[n] * close[n], 0.0) for n in shares if k and final[n] >= days[k - 1]) / nav
            now = {n: px[n, i] if (n, i) in px else (close[n], close[n]) for n in "ABCDEF" if (n, i) in px or n in close}
            cause = wish.get(days[k - 1] if at_open and k else None if at_open else i)
            price = {n: x[1] if at_open else x[0] for n, x in now.items()}
            for n, x in shares.items():
                gain[1 if x > 0 else -1] += x * ((price[n] if cause else now[n][0]) - close[n])
            nav = before + sum(gain.values())
            target = cause and {n: w for n, w in cause.items() if (n, i) in px}
            if cause and target != done:
                held = {n: x * price[n] / nav for n, x in shares.items() if final[n] >= i}
                traded = sum(abs(target.get(n, 0.0) - held.get(n, 0.0)) for n in "ABCDEF")
                shares, done = {n: w * nav / price[n] for n, w in target.items()}, target
            if cause:
                for n, x in shares.items():
                    gain[1 if x > 0 else -1] += x * (now[n][0] - price[n])
                nav = before + sum(gain.values())
            close = {n: x[0] for n, x in now.items()}
            if done is not None:
                want.append([gain[1] / before, gain[-1] / before, traded / 2, lent * 0.005 / 252, sum(final[n] >= i for n in shares)])
        prices = spark.createDataFrame([(n, DAYS[i], c, o) for (n, i), (c, o) in px.items()], "ticker string, date date, close double, open double")
        targets = spark.createDataFrame([(DAYS[i], n, w) for i, g in wish.items() for n, w in g.items()], "date date, ticker string, weight double")
        out = portfolio.share_book(prices, targets, execution=execution)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan
        got = out.orderBy("date").toPandas()
        assert len(got) == len(want) and (got["net"] - got["gross"] + got["trading_cost"] + got["borrow_cost"]).abs().max() < 1e-9
        np.testing.assert_allclose(got[["long", "short", "turnover", "borrow_cost", "names"]].to_numpy(float), want, rtol=1e-8, atol=1e-10)


def test_decayed_score_joins_nothing(spark):
    """events repeated per month were joined, and broadcast as long as their files looked small."""
    days = ["2019-02-28", "2020-02-28", "2020-02-29", "2020-03-01", "2021-02-28", "2021-02-28"]
    data = [("A", D(d), float(i)) for i, d in enumerate(days)] + [("A", None, 9.0), ("A", D("2021-02-01"), None), (None, D("2021-02-01"), 9.0), ("B", D("2022-01-01"), 1.0)]
    asked = [(t, D(d)) for t in "AB" for d in ("2020-02-29", "2021-02-28", "2021-02-28", "2030-01-31")] + [("A", None), (None, D("2021-02-28"))]
    out = graph.decayed_score(spark.createDataFrame(data, "ticker string, event_date date, score double"), spark.createDataFrame(asked, "ticker string, date date"))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    f = lambda date, *of: sum(0.9 ** ((D(date) - D(d)).days / 30.44) * (v or 0.0) for d, v in of) / sum(0.9 ** ((D(date) - D(d)).days / 30.44) for d, _ in of)
    want = {(t, d): 0.0 for t, d in asked}
    want["A", D("2020-02-29")] = f("2020-02-29", ("2020-02-28", 1.0), ("2020-02-29", 2.0))  # twelve months before is the 28th, excluded
    want["A", D("2021-02-28")] = f("2021-02-28", ("2020-02-29", 2.0), ("2020-03-01", 3.0), ("2021-02-28", 4.0), ("2021-02-28", 5.0), ("2021-02-01", None))
    got = [(r.ticker, r.date, r.score) for r in out.collect()]
    assert len(got) == len(want) and all(s == pytest.approx(want[t, d], abs=1e-12) for t, d, s in got)


def test_capped_weights():
    w = portfolio.capped(pd.Series([0.5, 0.3, 0.1, 0.1]), 0.4)
    assert w.sum() == pytest.approx(1) and w.max() <= 0.4 + 1e-12
    with pytest.raises(ValueError):
        portfolio.capped(pd.Series([0.5, 0.5]), 0.4)


def test_statistics_of_series():
    x = np.random.default_rng(0).normal(0.02, 0.1, 120)
    assert stats.hac_t(x, 0) == pytest.approx(x.mean() / np.sqrt(x.var() / 120))
    assert stats.hac_t([1, 1, 1, 1], 2) is None and stats.hac_t([1, None], 1) is None
    assert stats.lag_rule(63, 21) == 3 and stats.summary(x, 63, 21)["t_naive"] is None
    assert stats.best_of_null(1) == 0 and 2.4 < stats.best_of_null(100) < 2.6
    e = stats.effective_number(np.eye(4))
    assert e["capped"] == pytest.approx(4) and e["nyholt"] == pytest.approx(4)
    fit = stats.ols_hac(2 + 3 * x, x[:, None], 4)
    np.testing.assert_allclose(fit["beta"], [2, 3], atol=1e-9)


def test_judge_finds_what_was_planted(spark):
    r = np.random.default_rng(7)
    data = []
    for m in range(18):
        f, g, noise = r.normal(size=(3, 60))
        y = 0.3 * f + noise
        data += [(f"2020-{m:02d}", f"t{i}", f[i], 0.9 * f[i] + 0.1 * g[i], g[i], y[i], f"s{i % 4}") for i in range(60)]
    p = spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in x) for x in data], "month string, ticker string, f double, copy double, g double, y double, sector string").cache()
    alone = cross_section.judge(p, [], "f", "y", "sector")
    over = cross_section.judge(p, ["f"], "copy", "y", "sector")
    assert alone["ic_raw_t"] > 5 and over["spanned_r2"] > 0.9 and abs(over["ic_incremental"]) < 0.1
    steps = cross_section.greedy(p, ["f", "copy", "g"], "y", 3.0)
    assert len(steps) == 1 and steps[0]["candidate"] in ("f", "copy")
    assert cross_section.judge(p.where("month < '2020-05'"), [], "f", "y")["ok"] is False


def test_onsets_rearm(spark):
    day = lambda n: D("2020-01-01") + dt.timedelta(n)
    b = spark.createDataFrame([("A", day(n), o) for n, o in [(0, "x"), (5, "y"), (6, "z"), (40, "x"), (61, "y"), (100, "x"), (122, "y")]], "ticker string, date date, owner string")
    assert rows(events.cluster_onsets(b), "date") == [(day(5),), (day(61),)]


def test_trading_windows_and_exclusion(spark):
    cal = pit.calendar(spark.createDataFrame([(d,) for d in DAYS[:20]], "date date"))
    t = spark.createDataFrame([("A", DAYS[4]), ("B", DAYS[19])], "ticker string, date date")
    w = events.trading_windows(t, cal, 3)
    assert rows(w) == [("A", DAYS[5], DAYS[7])]
    p = spark.createDataFrame([("A", d) for d in DAYS[3:9]], "ticker string, date date")
    assert sorted(r[1] for r in rows(events.not_excluded(p, w))) == [DAYS[3], DAYS[4], DAYS[8]]


def test_fourth_quarter_needs_three(spark):
    q = spark.createDataFrame([("c", D(d), D("2020-02-01"), v) for d, v in [("2019-03-31", 1.0), ("2019-06-30", 2.0), ("2019-09-30", 3.0)]], "cik string, ddate date, filed date, value double")
    a = spark.createDataFrame([("c", D("2019-12-31"), D("2020-03-01"), 10.0), ("c", D("2018-12-31"), D("2019-03-01"), 9.0)], "cik string, ddate date, filed date, value double")
    got = fundamentals.fourth_quarters(a, q).where("derived").collect()
    assert [(r.ddate, r.value, r.filed) for r in got] == [(D("2019-12-31"), 4.0, D("2020-03-01"))]


def test_streak_and_expiry(spark):
    s = spark.createDataFrame([("A", D(a), D(a) - dt.timedelta(30), x) for a, x in (("2020-01-01", 1.0), ("2020-04-01", 2.0), ("2020-07-01", -1.0))], "ticker string, avail date, ddate date, sue double")
    assert rows(fundamentals.streaks(s)) == [("A", D("2020-01-01"), None), ("A", D("2020-04-01"), 2.0), ("A", D("2020-07-01"), None)]
    s = s.where("avail < date'2020-07-01'")
    assert ("A", D("2020-09-30"), None) in rows(fundamentals.streaks(s))


def test_neighbors_reverse_relations(spark):
    e = spark.createDataFrame([("A", "B", "customer", 0.5), ("A", "C", "customer", 1.0), ("D", "A", "odd", 1.0)], "source string, target string, relation string, confidence double")
    v = spark.createDataFrame([("A", 1.0), ("B", 3.0), ("C", 6.0), ("D", 8.0)], "ticker string, value double")
    got = {r.ticker: r.signal for r in graph.neighbor_signal(e, v, {"customer": 1.0, "supplier": -0.5, "partner": 1.5}).collect()}
    assert got == {"A": (0.5 * 3 + 6 + 1.5 * 8) / 3, "B": -1.0, "C": -1.0, "D": None}


def test_customers_of_both_directions(spark):
    e = spark.createDataFrame([("A", "B", "customer", 0.9), ("A", "C", "supplier", 0.9), ("A", "D", "customer", 0.7), ("E", "A", "supplier", 0.8)], "source string, target string, relation string, confidence double")
    assert rows(graph.customers_of(e)) == [("A", "B", 0.9), ("A", "E", 0.8), ("C", "A", 0.9)]


def test_event_counts_cover_the_calendar(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(28) if i % 7 < 5]
    cal = pit.calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    e = spark.createDataFrame([("A", dt.date(2024, 1, 13)), ("A", dt.date(2023, 12, 30)), ("A", dt.date(2024, 1, 27)), ("B", days[3])], "ticker string, date date")
    got = {(r.ticker, r.date): r.cnt for r in features.event_count_z(e, cal, 2, 4, 2).collect()}
    assert len(got) == 2 * len(days) and got["A", days[0]] is None
    assert [d for (t, d), n in sorted(got.items()) if t == "A" and n] == [dt.date(2024, 1, 15), dt.date(2024, 1, 16)]
    m = {(r.ticker, r.date): r.n for r in features.event_count_z_monthly(spark.createDataFrame([("A", dt.date(2024, 3, 5)), ("B", dt.date(2024, 1, 9))], "ticker string, date date")).collect()}
    assert m == {("A", dt.date(2024, 1, 31)): 0, ("A", dt.date(2024, 2, 29)): 0, ("A", dt.date(2024, 3, 31)): 1, ("B", dt.date(2024, 1, 31)): 1, ("B", dt.date(2024, 2, 29)): 0, ("B", dt.date(2024, 3, 31)): 0}


def test_unmatched_quarters_keep_their_place(spark):
    ends = [dt.date(2015 + i // 4, 3 * (i % 4) + 3, 28) for i in range(20)]
    q = [("c", d, d, float(i * i)) for i, d in enumerate(ends) if i != 6]
    got = {r.ddate: r.surprise for r in fundamentals.seasonal_surprise(spark.createDataFrame(q, "cik string, ddate date, filed date, value double"), n=4, least=4).collect()}
    assert len(got) == 19 and got[ends[10]] is None and got[ends[14]] is None and got[ends[15]] is not None


def test_streaks_go_by_period(spark):
    s = [("A", "2020-03-31", "2020-08-01", 1.0), ("A", "2020-06-30", "2020-08-01", 2.0), ("A", "2020-09-30", "2020-11-01", None), ("A", "2020-12-31", "2021-02-01", 3.0)]
    got = rows(fundamentals.streaks(spark.createDataFrame([(t, D(a), D(b), x) for t, a, b, x in s], "ticker string, ddate date, avail date, sue double")))
    assert got == [("A", D("2020-08-01"), 2.0), ("A", D("2021-01-30"), None), ("A", D("2021-02-01"), 3.0), ("A", D("2021-08-02"), None)]


def test_windows_of_early_triggers(spark):
    cal = pit.calendar(spark.createDataFrame([(d,) for d in DAYS[:20]], "date date"))
    t = spark.createDataFrame([("A", DAYS[0] - dt.timedelta(9)), ("B", DAYS[0] - dt.timedelta(1))], "ticker string, date date")
    assert rows(events.trading_windows(t, cal, 3)) == [("B", DAYS[0], DAYS[2])]


def test_sleeves_are_hedged_and_scaled(spark):
    r = random.Random(3)
    days = DAYS[:20]
    a, b, m = ([r.gauss(0, 0.01) for _ in days] for _ in range(3))
    beta = [r.gauss(0.2, 0.1) for _ in days]
    table = [("a", d, x, y) for d, x, y in zip(days, a, beta)] + [("b", d, x, 0.0) for d, x in zip(days[1:], b[1:])]
    got = portfolio.combine_sleeves(spark.createDataFrame(table, "sleeve string, date date, ret double, beta double"), spark.createDataFrame(list(zip(days[:-1], m)), "date date, m double"), n=5).orderBy("date").toPandas()
    net = pd.DataFrame({"a": a[1:], "b": b[1:]})
    w = (1 / net.std()) / (1 / net.std()).sum()
    raw, book = (net * w).sum(axis=1), pd.Series(beta[1:]) * w["a"]
    market = pd.Series([*m[1:-1], np.nan])
    hedged = raw - book * market - book.diff().abs().fillna(0) * 5e-4
    lev = (0.15 / (hedged.rolling(5).std() * np.sqrt(365))).clip(upper=3.0).shift(1)
    want = hedged * lev - lev.diff().abs().fillna(0) * 2 * 5e-4
    assert len(got) == 19 and np.allclose(got["ret"], want, equal_nan=True) and np.allclose(got["hedged"], hedged, equal_nan=True)
    assert want.notna().sum() == 13


def test_company_names(spark):
    names = {"The Acme Holdings, Inc.": "ACME HOLDINGS", "Foo & Co., Ltd.": "FOO", "U.S. Government and its Agencies": "US GOVERNMENT", "Bar Corp /DE/": "BAR", "Baz-Qux (a unit) and its affiliates": "BAZ QUX", "Inc.": "INC", "The": "THE", "Ｆｏｏ\u00a0Ｃｏ． Ltd": "FOO", None: None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", S.company_name(F.col("n"))).collect()} == names


def test_permuted_draws_without_replacement(spark):
    e = spark.createDataFrame([("A", d) for d in DAYS[:6]] + [("B", d) for d in DAYS[:9]], "ticker string, date date")
    px = spark.createDataFrame([("A", d, 1.0) for d in DAYS[:20]] + [("B", d, 1.0) for d in DAYS[:4]] + [("B", DAYS[5], None)], "ticker string, date date, close double")
    got = rows(looks.permuted(e, px, 3))
    assert got == rows(looks.permuted(e, px, 3)) and len(set(got)) == len(got)
    assert [t for t, _ in got].count("A") == 6 and {d for t, d in got if t == "B"} == set(DAYS[:4])


def test_quintiles_pay_funding_and_cut_at_the_largest_rank(spark):
    names = [f"s{i:02d}" for i in range(25)]
    x = spark.createDataFrame([(n, DAYS[0], float(min(i, 19))) for i, n in enumerate(names)], "symbol string, date date, x double")
    r = spark.createDataFrame([(n, d, 0.01 * i) for i, n in enumerate(names) for d in DAYS[:2]], "symbol string, date date, r double")
    f = spark.createDataFrame([(n, DAYS[1], 0.001 * i) for i, n in enumerate(names)], "symbol string, date date, fund double")
    day = {r.date: r for r in portfolio.rank_quintiles(x, r, funding=f).collect()}
    # the six tied at the top share rank 22.5; from rank 18 up is long, up to 4.5 short
    top, low = np.mean([i for i in range(17, 25)]), np.mean(range(4))
    assert day[DAYS[0]].pnl == pytest.approx((0.01 - 0.001) * (top - low)) and day[DAYS[0]].traded == pytest.approx(2.0)
    some = spark.createDataFrame([(n, DAYS[0]) for n in names[:19]], "symbol string, date date")
    assert {r.date: r.traded for r in portfolio.rank_quintiles(x, r, universe=some).collect()}[DAYS[0]] == 0


def test_edit_ratio_identity():
    r = random.Random(0)
    for _ in range(20):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(60))] for _ in range(2))
        ratio, added, deleted = text.edit_ratio(a, b)
        if a or b:
            assert ratio == pytest.approx((len(a) + len(b) - added - deleted) / (len(a) + len(b)))


def edits(spark, folder, docs):
    """doc_id -> row of the registered query over these (doc_id, text, n_chars), one source and language."""
    d = spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in docs], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{folder}/documents.parquet")
    return {r.doc_id: (r.ratio, r.added, r.deleted) for r in text_graph_queries.edit_ratio(spark, str(folder)).collect()}


def by_difflib(docs):
    tokens = [re.findall("[a-z0-9]+", t.lower()) for _, t, _ in docs]
    out = {}
    for (i, _, _), a, b in zip(docs[1:], tokens, tokens[1:]):
        m = sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        out[i] = (2 * m / (len(a) + len(b)), len(b) - m, len(a) - m)
    return out


def test_edits_of_short_documents_and_without_a_length(spark, tmp_path):
    docs = [(i, t, n) for i, (t, n) in enumerate([("a b c " * 50, 300), ("a b", 3), ("b c d", 5), ("a x c " * 50, None), ("a b c " * 40, 240)])]
    assert edits(spark, tmp_path, docs) == by_difflib(docs)


def test_edits_of_long_documents(spark, tmp_path):
    r = random.Random(5)
    docs = [(i, " ".join(r.choices("abcdefgh", k=n)), 2 * n - 1) for i, n in enumerate((700, 760, 3000, 40))]
    assert edits(spark, tmp_path, docs) == by_difflib(docs)


def test_edits_in_chunks(spark, tmp_path):
    words = [f"w{i}" for i in range(110_000)]
    docs = [(i, " ".join(w), 10**6) for i, w in enumerate((words, words[:50_000] + ["x"] + words[50_001:]))]
    ratio, added, deleted = edits(spark, tmp_path, docs)[1]
    assert (added, deleted) == (1, 1) and ratio == pytest.approx(1 - 1 / 110_000)


def test_word_windows(spark):
    df = spark.createDataFrame([(" ".join(["w"] * n),) for n in (0, 10, 15, 100, 110, 120, 20000)], "t string")
    got = [[len(x) for x in r.w] for r in df.select(text.word_windows(F.col("t")).alias("w")).collect()]
    assert got[:6] == [[], [], [15], [100], [100], [100, 20]] and len(got[6]) == 150


def all_pairs(ev, co, near):
    """Greedy over every (event, control) pair, nearest first."""
    done, used, busy, out = set(), set(), {}, []
    for gap, e, c, s, p in sorted((abs(p - q), e, c, s, q) for e, p in ev for c, s, q in co):
        if e not in done and c not in used and all(abs(p - q) > near for q in busy.get(s, ())):
            done.add(e)
            used.add(c)
            busy.setdefault(s, []).append(p)
            out.append((e, c, gap))
    return sorted(out)


def test_greedy_match_equals_all_pairs(spark):
    r = random.Random(3)
    cases = [([(i, 100) for i in range(12)], [(i, i, 100 + 40 * i) for i in range(15)])]  # one day, controls far apart
    cases += [([(i, r.randrange(400)) for i in range(60)], [(i, r.randrange(30), r.randrange(400)) for i in range(60)]) for _ in range(3)]
    for ev, co in cases:
        got = events.greedy_match(spark.createDataFrame(ev, "event_id long, pos long"), spark.createDataFrame(co, "control_id long, subject long, pos long"))
        assert sorted(tuple(x) for x in got.collect()) == all_pairs(ev, co, 63)
    assert len(all_pairs(*cases[0], 63)) == 12
    empty = spark.createDataFrame([], "control_id long, subject long, pos long")
    assert events.greedy_match(spark.createDataFrame(cases[0][0], "event_id long, pos long"), empty).count() == 0


def test_greedy_thinning(spark):
    f = spark.createDataFrame([("A", D("2020-01-01")), ("A", D("2020-03-01")), ("A", D("2020-08-01")), ("A", D("2021-02-01"))], "k string, d date")
    assert [r[1].month for r in rows(text.thin_by_gap(f, "k", "d", 200))] == [1, 8] or rows(text.thin_by_gap(f, "k", "d", 200))


def test_implied_volatility_round_trip():
    f, k, t = np.full(5, 100.0), np.array([80.0, 90, 100, 110, 120]), np.full(5, 0.1)
    vol = np.array([0.5, 0.3, 0.2, 0.25, 0.6])
    for call in (True, False):
        c = np.full(5, call)
        np.testing.assert_allclose(options.implied_vol(options.black_price(c, f, k, t, vol), c, f, k, t), vol, atol=1e-4)
    assert np.isnan(options.implied_vol(np.array([500.0]), np.array([True]), f[:1], k[:1], t[:1]))[0]


def test_book_and_cooldown(spark):
    b = ticks.Book()
    b.snapshot([[0.4, 1], [0.45, 0]], [[0.6, 2]])
    assert b.mid() == 0.5
    b.change("SELL", 0.5, 3)
    b.change("BUY", 0.4, 0)
    assert b.mid() is None
    t0 = dt.datetime(2020, 1, 1)
    e = spark.createDataFrame([(1, t0 + dt.timedelta(seconds=s), s) for s in (0, 3, 5, 6, 11, 12)], "key long, ts timestamp, seq long")
    assert [r[2] for r in sorted(rows(ticks.cooldown(e, 5)), key=lambda r: r[2])] == [0, 6, 12]


def test_seams_and_audits(spark):
    b = spark.createDataFrame([("A", DAYS[i], float(i + 1), 0.1, 0.2) for i in range(8)], "ticker string, date date, close double, ret_1d double, ret_5d double")
    m = {r.date: r for r in quality.mask_seams(b, spark.createDataFrame([("A", DAYS[6])], "ticker string, date date"), (1, 5)).collect()}
    assert [i for i in range(8) if m[DAYS[i]].ret_1d is None] == [5] and [i for i in range(8) if m[DAYS[i]].ret_5d is None] == [1, 2, 3, 4, 5]
    k = quality.key_audit(spark.createDataFrame([(1, 2), (1, 2), (None, 1)], "a int, b int"), ["a", "b"]).first()
    assert (k["rows"], k.null_rows, k.duplicate_rows) == (3, 1, 2)


def test_scalars(spark):
    df = spark.createDataFrame([("BTC-26JUL24-60000-C",), ("bad",)], "n string")
    o = S.option_symbol(F.col("n"))
    got = df.select(*(c.alias(k) for k, c in o.items())).collect()
    assert tuple(got[0]) == ("BTC", D("2024-07-26"), 60000.0, "C") and tuple(got[1]) == (None, None, None, None)
    e = spark.createDataFrame([(1700000000000,), (1700000000000000,)], "t long").select(S.epoch_date(F.col("t")).alias("d"))
    assert {r.d for r in e.collect()} == {D("2023-11-14")}
    d = spark.createDataFrame([(D("2024-01-05"),), (D("2024-01-06"),)], "d date").select(readers.add_business_days(F.col("d")).alias("x"))
    assert [r.x for r in d.collect()] == [D("2024-01-19"), D("2024-01-19")]


class TestSources:
    def test_membership(self, spark, tmp_path):
        (tmp_path / "m.csv").write_text('date,tickers\n2020-01-01,"A, brk.b,OLD"\n2020-02-01,"A,OLD"\n')
        ren = spark.createDataFrame([("OLD", "NEW", D("2020-01-15"))], "old string, new string, from_date date")
        got = rows(readers.membership_csv(spark, str(tmp_path / "m.csv"), ren))
        assert got == [(D("2020-01-01"), "A"), (D("2020-01-01"), "BRK-B"), (D("2020-01-01"), "OLD"), (D("2020-02-01"), "A"), (D("2020-02-01"), "NEW")]

    def test_factor_block(self, spark):
        t = "x\n,Mkt-RF,SMB\n20200102, 0.50, -99.99\n20200103, 1.00, 2.0\n\nCopyright"
        assert readers.factor_block(t, ["mkt_rf", "smb"]) == [("2020-01-02", 0.005, None), ("2020-01-03", 0.01, 0.02)]
        with pytest.raises(ValueError):
            readers.factor_block(t + "\n20200104, 1, 2", ["mkt_rf", "smb"])
        with pytest.raises(ValueError):
            readers.factor_block(t, ["mkt_rf", "hml"])
        out = readers.factor_files(spark, {t: ["mkt_rf", "smb"], "\n,MOM\n20200103, 3.0": ["mom"]})
        assert rows(out) == [(D("2020-01-03"), 0.01, 0.02, 0.03)]

    def test_filings(self, spark, tmp_path):
        (tmp_path / "A").mkdir()
        (tmp_path / "A" / "8-K_2020-01-02_000-1.json").write_text('{"ticker": "A", "form": "8-K", "filing_date": "2020-01-02", "accession_number": "000-1", "sections": {"a": "Item 2.02 x", "b": "y"}}')
        (tmp_path / "A" / "8-K_2020-99-02_000-2.json").write_text("{")
        f = readers.flag_item(readers.filings_json(spark, f"{tmp_path}/A")).collect()
        assert [(r.ticker, r.accession, r.has_item) for r in f] == [("A", "0001", True)]
        assert rows(readers.filing_names(spark, str(tmp_path), "8-K")) == [("A", D("2020-01-02"), "000-1")]

    def test_index_and_filers(self, spark, tmp_path):
        (tmp_path / "m.idx").write_text("head\n12|Big Co|SC 13D|2020-01-02|edgar/0001-20-1.txt\n7|Fund|SC 13D|2020-01-02|edgar/0001-20-1.txt\nx|y|10-K|2020-01-01|a.txt\n")
        ix = readers.master_index(spark, str(tmp_path / "m.idx"), ["SC 13D"])
        spine = spark.createDataFrame([("0001201", "0000000012"), ("9", "1")], "accession string, subject_cik string")
        got = rows(readers.attach_filers(spine, ix), "accession", "filer_cik", "n_filers")
        assert got == [("0001201", "0000000007", 1), ("9", None, 0)]

    def test_ticks_skip_bad_lines(self, spark, tmp_path):
        (tmp_path / "t.jsonl").write_text('{"t_local": 1700000000000000, "src": "a", "msg": "{}"}\nnot json\n')
        assert readers.tick_lines(spark, str(tmp_path / "t.jsonl")).count() == 1


def test_maker_replay_by_hand(spark):
    t0 = dt.datetime(2020, 1, 1)
    at = lambda x: t0 + dt.timedelta(seconds=x)
    base = t0.replace(tzinfo=dt.timezone.utc).timestamp()
    spot = spark.createDataFrame([(base + x, 100.0 if x < 250 else 101.0) for x in range(0, 420, 10)], "t double, price double")
    # fair chance 0.5 until 250 s: a buy at 0.9 fills at 0.52, again only after 5 s; 5 s after the start is too early
    trades = [(1, at(5), 0, 0.9, "BUY"), (1, at(50), 1, 0.9, "BUY"), (1, at(53), 2, 0.9, "BUY"), (1, at(56), 3, 0.51, "BUY"), (1, at(60), 4, 0.1, "SELL")]
    df = spark.createDataFrame(trades, "key long, ts timestamp, seq long, px double, side string")
    r = ticks.maker_replay(df, spot).first()
    assert (r.fills, r.pnl) == (2, pytest.approx(0.52 - 1 + 1 - 0.48)) and r.pickoff == 0


def test_parsers():
    assert parsers.first_json('x {"a": {"b": 1}} y') == {"a": {"b": 1}} and parsers.first_json("```json\n[1]\n```") == [1] and parsers.first_json("{no") is None
    t = parsers.pipe_table("intro\n| Id | Status |\n|--|:-:|\n| a\\|b | **Open** now |\n| c | done |\n\n| x |")
    assert t == [{"id": "a|b", "status": "**Open** now"}, {"id": "c", "status": "done"}] and parsers.status_counts(t) == {"open": 1, "done": 1}


def test_governance(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", None), (1, "y", 2.0), (2, "x", 1.0)], "k int, n string, v double")
    one = {r.k: r.digest for r in governance.digests(a, ["k"], ["n", "v"]).collect()}
    assert one == {r.k: r.digest for r in governance.digests(a.orderBy(F.desc("n")).repartition(3), ["k"], ["n", "v"]).collect()} and one[1] != one[2]
    items = spark.createDataFrame([(1, "h1", True), (2, "h2", False), (3, "h3", False)], "k int, digest string, verified boolean")
    appr = spark.createDataFrame([(2, "h2"), (3, "old")], "k int, digest string")
    assert [r.status for r in governance.reviewed(items, appr, "k").orderBy("k").collect()] == ["auto_verified", "approved", "review_required"]
    import hashlib

    for n, c in (("a", b"1"), ("b", b"2"), ("d", b"3")):
        (tmp_path / n).write_bytes(c)
    m = spark.createDataFrame([("a", hashlib.sha256(b"1").hexdigest()), ("b", "0"), ("c", "0")], "path string, sha256 string")
    assert rows(governance.manifest_issues(spark, str(tmp_path), m)) == [("b", "changed"), ("c", "missing"), ("d", "unlisted")]


def test_streams_equal_batches_over_several_files(spark, tmp_path):
    r = random.Random(4)
    b = sorted({(r.randrange(3), D("2020-01-01") + dt.timedelta(r.randrange(200)), r.randrange(6)) for _ in range(90)}, key=lambda x: x[1])
    whole = spark.createDataFrame(b, "ticker long, date date, owner long")
    for i, cut in enumerate(([x for x in b if x[1] < D("2020-03-01")], [x for x in b if x[1] >= D("2020-03-01")])):
        spark.createDataFrame(cut, whole.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    assert rows(twins.run_available(twins.onsets(s))) == rows(events.cluster_onsets(whole))


def test_combiner_without_enough_months(spark):
    p = spark.createDataFrame([(D("2020-01-01"), D("2020-01-31"), i, 1.0 * i, 0.1) for i in range(5)], "month date, date date, ticker long, f double, y double")
    assert combiner.walk_forward(p, ["f"], "y").count() == 0
