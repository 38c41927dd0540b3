"""Walks by priority, path rules, addresses, hints and required texts against plain forms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from listingwatch.functions import urls
from listingwatch.operators import frontier, pages, rules
from listingwatch.plans import walking
from listingwatch.sources import tables

SF = "/root/testdata/sf0.001"


def walked_plain(walk, pages_of, links_of):
    """One queue, one item at a time."""
    rows, seq = {}, 0
    for url, kind, priority in ((walk["robots_url"], "robots", 120), (walk["sitemap_url"], "sitemap", 110), (walk["seed"], "page", 100)):
        if url is not None and url not in rows:
            rows[url] = {"kind": kind, "priority": priority, "depth": 0, "seq": seq, "status": "pending", "place": None, "found_on": None}
        seq += 1
    n = size = candidates = 0
    seconds, stop = 0.0, None
    while stop is None:
        stop = "page_budget" if n >= walk["max_pages"] else "byte_budget" if size >= walk["max_bytes"] else "time_budget" if seconds >= walk["max_seconds"] else None
        waiting = [(-r["priority"], r["seq"], u) for u, r in rows.items() if r["status"] == "pending"]
        if stop or not waiting:
            break
        url = min(waiting)[2]
        item, page = rows[url], pages_of.get(url)
        if item["depth"] > walk["max_depth"] or (page and item["kind"] == "page" and not page["allowed"]):
            item["status"] = "skipped"
            continue
        seconds += max(walk["min_interval"], page["seconds"] if page else 0)
        if page is None or page["status"] >= 400:
            item["status"] = "failed"
            stop = "refused" if page and page["status"] in (401, 403, 429) else None
            continue
        n, size = n + 1, size + page["bytes"]
        item["status"], item["place"] = "visited", n
        candidates += page["candidate"] and item["kind"] == "page"
        if item["kind"] != "page" or item["depth"] < walk["max_depth"]:
            for _, target, kind, priority in sorted(links_of.get(url, [])):
                if target not in rows:
                    depth = item["depth"] if kind == "sitemap" else 1 if item["kind"] == "sitemap" else item["depth"] + 1
                    rows[target] = {"kind": kind, "priority": priority, "depth": depth, "seq": seq, "status": "pending", "place": None, "found_on": url}
                    seq += 1
        if item["kind"] == "page" and walk["active_recipe"] and n >= 10 and candidates == 0:
            stop = "fruitless_recipe"
    return rows, (n, size, seconds, candidates, sum(r["status"] == "pending" for r in rows.values()), stop)


def check_walks(walks, fetched, links, window):
    pages_of = {r["url"]: r.asDict() for r in fetched.collect()}
    links_of = {}
    for r in links.collect():
        links_of.setdefault(r["url"], []).append((r["nth"], r["target"], r["kind"], r["priority"]))
    found, summary = frontier.best_first(walks, fetched, links, window=window)
    got = {}
    for r in found.collect():
        assert (r["walk_id"], r["url"]) not in got
        got[r["walk_id"], r["url"]] = tuple(r[c] for c in ("kind", "priority", "depth", "seq", "status", "place", "found_on"))
    totals = {r["walk_id"]: tuple(r)[1:7] for r in summary.collect()}
    stops = set()
    for walk in walks.collect():
        rows, total = walked_plain(walk.asDict(), pages_of, links_of)
        assert {u: tuple(r.values()) for u, r in rows.items()} == {u: v for (w, u), v in got.items() if w == walk["walk_id"]}
        assert totals[walk["walk_id"]] == total
        stops.add(total[-1])
    return stops


def test_walks_of_the_tables_equal_one_queue(spark):
    assert len(check_walks(*walking.walk_tables(spark, SF), window=8)) >= 2


@pytest.mark.parametrize("seed, window", [(1, 1), (2, 3)])
def test_random_walks_equal_one_queue(spark, seed, window):
    """Budgets that end in the middle of a level, refusals, missing pages, maps of maps, links back, ties of priority."""
    rng = random.Random(seed)
    names = [f"u{i}" for i in range(40)]
    walks = [(w, rng.choice([*names, None]), f"r{w}" if w % 3 else None, f"m{w}", rng.randrange(1, 25), rng.randrange(3), rng.randrange(500, 9000), float(rng.randrange(4, 60)), 1.0, w % 2 == 0) for w in range(12)]
    fetched = [(u, rng.choice([200] * 12 + [404, 403]), rng.randrange(600), rng.random() * 3, rng.random() < 0.9, rng.random() < 0.1) for u in [*names[:36], *(f"m{w}" for w in range(12)), *(f"r{w}" for w in range(9))]]
    links = [(u, i, rng.choice(names), "page", rng.choice([45, 60, 60, 80, 100])) for u in names for i in range(rng.randrange(6))]
    links += [(f"m{w}", i, rng.choice(names), "page", rng.choice([65, 90])) for w in range(12) for i in range(4)] + [(f"m{w}", 9, f"m{(w + 1) % 12}", "sitemap", 105) for w in range(12)]
    links += [(f"r{w}", 0, f"m{w % 4}", "sitemap", 115) for w in range(12)]
    made = (
        spark.createDataFrame(walks, "walk_id long, seed string, robots_url string, sitemap_url string, max_pages int, max_depth int, max_bytes long, max_seconds double, min_interval double, active_recipe boolean"),
        spark.createDataFrame(fetched, "url string, status int, bytes long, seconds double, allowed boolean, candidate boolean"),
        spark.createDataFrame(links, "url string, nth long, target string, kind string, priority int"),
    )
    assert len(check_walks(*made, window=window)) >= 3


def test_public_hosts(spark):
    hosts = {
        "fcbarcelona.com": True, "fdic.gov": True, "10.example.com": True, "fe80.org": True, "8.8.8.8": True, "127.1": True, "10.0.0.256": True, "172.32.0.1": True, "[2001:db8::1]": True,
        "10.0.0.1": False, "10.0.0.1.": False, "0.0.0.0": False, "::": False, "[::1]": False, "fe80::1%eth0": False, "[fd00::1]": False, "fc00::": False, "224.0.0.1": False, "255.255.255.255": False, "a.LOCAL": False, "localhost.": False, "x.internal": False, "": False,
    }
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.is_public(F.col("h"))).collect()
    assert {r[0]: r[1] for r in rows} == hosts


def robots_plain(path, rule_list):
    found = []
    for allow, pattern in rule_list:
        anchored = pattern.endswith("$")
        body = ".*".join(map(re.escape, re.sub(r"\$$", "", pattern).split("*")))
        if pattern and re.match(body + ("$" if anchored else ""), path):
            found.append((len(re.sub(r"[*$]", "", pattern)), allow))
    return max(found)[1] if found else True


def test_path_rules_equal_trying_all(spark):
    rng = random.Random(3)
    parts = ["/", "a", "b", "*", "$", "/a", ".", "?", "x=1", "(", "[b]", "+", "\\"]
    rule_list = list({(rng.random() < 0.4, "/" + "".join(rng.choices(parts, k=rng.randrange(6)))) for _ in range(80)} | {(False, "/fish*"), (True, "/fish"), (True, "*"), (False, "*a$")})
    paths = ["/" + "".join(rng.choices([p for p in parts if p != "*"] + ["fish"], k=rng.randrange(7))) for _ in range(200)] + ["/fish", "/fishes", "/"]
    body = "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rule_list)
    robots = pages.robots_rules(spark.createDataFrame([("a.com", body)], "host string, body string"), "me")
    asked = sorted({"https://a.com" + p for p in paths})
    got = {r["url"]: r["allowed"] for r in pages.robots_allowed(spark.createDataFrame([(u,) for u in asked] + [("https://b.com/",)], "url string"), robots).collect()}
    assert got.pop("https://b.com/")
    assert got == {u: robots_plain(u.removeprefix("https://a.com"), rule_list) for u in asked}


def test_sitemaps_of_robots_files(spark):
    body = "Sitemap: https://a.com/1.xml # first\r\nUser-agent: x\nDisallow: /\nSITEMAP:https://a.com/2.xml\nSitemap:\nsitemap https://no.com"
    found = pages.robots_sitemaps(spark.createDataFrame([("a.com", body), ("a.com", body), ("b.com", None)], "host string, body string")).collect()
    assert sorted(r["sitemap"] for r in found) == ["https://a.com/1.xml", "https://a.com/2.xml"]


def test_required_text_is_in_every_fitting_text():
    """Random patterns and texts: where the pattern is found, the required text is in the text."""
    rng = random.Random(9)
    atoms = ["abc", "def", "x", "1", " ", "-", r"\x41", r"\101", r"[\]abc]", "[^]]", "[a-c", r"\d", r"\.", "(abc)", "(ab|cd)", "(?:abc)", "|", "*", "+", "?", "{2}", "{0,1}", "{,", "^", "$", ".", r"a", r"\b", "]", "[]x]", r"\\", "(?i)", "(?#abc)"]
    seen = 0
    for _ in range(60_000):
        pattern = "".join(rng.choices(atoms, k=rng.randrange(1, 6)))
        try:
            fits = re.compile(pattern, re.IGNORECASE)
        except re.error:
            continue
        word = rules.required_text(pattern)
        if word is None:
            continue
        for _ in range(4):
            text = "".join(rng.choices(["abc", "ABC", "def", "x", "1", " ", "-", "A", "]", "Abcd", "aa", ".", "\\", "abcabc"], k=rng.randrange(1, 8)))
            if fits.search(text):
                seen += 1
                assert word in text.lower(), (pattern, text)
    assert seen > 1000
    assert rules.required_text(r"\x41bcd") is None and rules.required_text(r"[\]abc]def") == "def"
    assert rules.required_text("abc+def") == "abc" and rules.required_text("abcd?") == "abc" and rules.required_text("abc|def") is None


def test_rules_with_escapes_and_sets_match(spark):
    context = spark.createDataFrame([(1, ["Abcd chain"]), (2, ["xadefy"]), (3, ["none"])], "product_id long, base_values array<string>")
    asked = [(1, [r"\x41bcd"]), (2, [r"[\]abc]def"]), (3, ["abcd"]), (4, [r"\101bcd"]), (5, [r"[a-z]{4}$"]), (6, [r"(a)\1"])]
    found = rules.match_rules(context, spark.createDataFrame([(i, k, "regex") for i, k in asked], "rule_id long, keywords array<string>, mode string"))
    assert sorted((r["rule_id"], r["product_id"]) for r in found.collect()) == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 1), (5, 2), (5, 3)]


def test_too_many_loose_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(rules, "LOOSE", 2)
    context = spark.createDataFrame([(1, ["Abcd chain"])], "product_id long, base_values array<string>")
    many = spark.createDataFrame([(i, [r"\d"], "regex") for i in range(3)], "rule_id long, keywords array<string>, mode string")
    with pytest.raises(ValueError, match="more than 2"):
        rules.match_rules(context, many)


def test_scratch_deletes_its_own_tables_only(spark):
    outside = tables.cut(spark.range(3), "outside")
    with tables.Scratch(spark) as scratch:
        inside = tables.cut(spark.range(4), "inside")
        assert inside.count() == 4 and len(scratch.paths) == 1
        kept = tables.cut(spark.range(5), "kept")
        scratch.clear(kept)
        assert kept.count() == 5 and len(scratch.paths) == 1
    assert outside.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        kept.count()
