"""What products and rules have in common is folded and looked up once."""

import random

from pyspark.sql import functions as F
from test_rules import CONTEXT, RULE

from listingwatch.functions.text import alias_form
from listingwatch.operators import rules, watch


def test_folded_parts_are_the_folded_whole(spark):
    rng = random.Random(3)
    signs = ["a", "b-", "-", "－", "!", " ", "Σ", "́", "ﬁ", "x -", "- y", "‐", "　"]
    piece = lambda: "".join(rng.choice(signs) for _ in range(rng.randint(1, 4)))
    rows = [(i, [piece() for _ in range(rng.randint(0, 2))], [piece() for _ in range(rng.randint(0, 2))], None, None, None, None, None) for i in range(400)]
    df = rules.complete(spark.createDataFrame(rows, CONTEXT), rules.CONTEXT_COLUMNS).withColumn("syn", F.sha2(F.to_json("synonym_values"), 256))
    own, shared = rules.folded_context(df, 4)
    joined = F.array_join(F.concat("base_values", "synonym_values"), " ")
    whole = df.select("product_id", joined.alias("text"), alias_form(joined).alias("hay"))
    got = own.join(shared, "syn").select("product_id", rules.whole_text().alias("got_text"), rules.whole_hay().alias("got_hay")).join(whole, "product_id").collect()
    assert len(got) == 400 and not [r for r in got if (r.got_text, r.got_hay) != (r.text, r.hay)]


def test_common_work_is_done_once(spark, monkeypatch):
    products = [(i, [f"Thing {i}"], ["line a", "part b"], [f"BX-{i}"], None, 7, [70], "en") for i in range(6)]
    asked = [(i, ["line A"], "exact", None, None, None, None, None, None, None) for i in range(40)] + [(99, ["thing 3 li"], "contains", None, None, None, None, None, None, None)]
    seen, found = [], rules.candidates
    monkeypatch.setattr(rules, "candidates", lambda own, shared, bodies: seen.append((own.count(), shared.count(), bodies.count())) or found(own, shared, bodies))
    out = rules.match_rules(spark.createDataFrame(products, CONTEXT), spark.createDataFrame(asked, RULE))
    assert {(r.rule_id, r.product_id) for r in out.collect()} == {(r, p) for r in range(40) for p in range(6)} | {(99, 3)}
    assert out.count() == 241 and seen == [(6, 1, 2)]


def test_first_rules_are_those_of_all_matches(spark):
    products = [(i, [f"Thing {i % 4}"], ["line a"], [f"BX-{i}"], None, 7, [70], "en") for i in range(8)]
    asked = [(i, [f"thing {i % 3}"] if i % 2 else ["line A"], "exact", None, None, None, None, None, None, None) for i in range(40)]
    context, wanted = spark.createDataFrame(products, CONTEXT), spark.createDataFrame(asked, RULE)
    first = lambda found: {(r.product_id, r.rule_id) for r in found.groupBy("product_id").agg(F.min("rule_id").alias("rule_id")).collect()}
    every, some = rules.match_rules(context, wanted), rules.match_rules(context, wanted, first_only=True)
    assert first(every) == first(some) and some.count() == 8 + 6 and every.count() > 160


def test_newest_alerts_ask_older_events_only_while_too_few(spark):
    rng = random.Random(2)
    events = [(i, i % 50) for i in rng.sample(range(4000), 3000)]
    for told, n in ((1, 10), (37, 10), (1500, 40), (5000, 5)):  # an event in so many has alerts, three each
        asked = []

        def alerts_of(some):
            asked.append(some.count())
            keys = F.explode(F.array(*[F.concat_ws(":", F.lit(k), "event_id") for k in "bca"])).alias("dedup_key")
            return some.where(F.col("event_id") % told == told - 1).select("event_id", keys)

        df = spark.createDataFrame(events, "event_id long, product_id long")
        newest = lambda found: [tuple(r) for r in found.orderBy(F.desc("event_id"), "dedup_key").limit(n).collect()]  # noqa: E731, B023
        got = newest(watch.newest_alerts(df, n, alerts_of))
        assert asked[0] == n and asked == sorted(asked) and (told > 1 or asked == [n])
        assert got == newest(alerts_of(df))
