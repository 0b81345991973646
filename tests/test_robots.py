"""Robots rules and answers in force against plain models."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from marketloom.operators import robots

ANSWER = "origin string, at timestamp, status int, body string"
DAY = dt.datetime(2024, 1, 1)
O = "https://h.example"


def allowed(spark, body, *paths, agent="marketbot/2", status=200):
    rules = robots.rules_of(spark.createDataFrame([(O, DAY, status, body)], ANSWER), agent)
    rows = robots.judged(spark.createDataFrame([(i, O + p) for i, p in enumerate(paths)], "i int, url string"), rules).orderBy("i").collect()
    return [r.allowed for r in rows]


def test_groups_and_agents(spark):
    body = "Disallow: /lost\nUser-agent: a\nUser-agent: *\nDisallow: /x\nUser-Agent : Market\nDisallow: /m\n\nuser-agent: marketbot\nDisallow: /b\nUser-agent: marketbot\nDisallow: /c"
    assert allowed(spark, body, "/lost", "/x", "/m", "/b", "/c") == [True, True, True, False, False]
    assert allowed(spark, body, "/x", "/m", "/b", agent="supermarket") == [True, False, True]
    assert allowed(spark, body, "/x", "/m", agent="other") == [False, True]
    assert allowed(spark, "User-agent: marketbot\nUser-agent: z\n\nUser-agent: *\nDisallow: /", "/x") == [False]
    assert allowed(spark, "User-agent: z\nDisallow: /", "/x") == [True] and allowed(spark, "", "/x") == [True]


def test_answers_that_are_no_rules(spark):
    all_ = "User-agent: *\nDisallow: /"
    assert allowed(spark, all_, "/x", "/robots.txt") == [False, True]
    assert [allowed(spark, all_, "/x", status=s)[0] for s in (404, 401, 429, 500, 503, None, 204)] == [True, True, False, False, False, False, False]
    assert allowed(spark, None, "/x") == [False]
    rules = robots.rules_of(spark.createDataFrame([(O, DAY, 200, all_)], ANSWER), "m")
    rows = robots.judged(spark.createDataFrame([("ftp://h.example/x",), (None,), ("https://other.example/",)], "url string"), rules).collect()
    assert {r.url: r.allowed for r in rows} == {"ftp://h.example/x": False, None: False, "https://other.example/": None}


def plain(rules, path):
    """Longest match by a walk over the pattern, allowing before forbidding."""

    def match(pattern, text):
        if not pattern:
            return True
        if pattern == "$":
            return not text
        if pattern[0] == "*":
            return any(match(pattern[1:], text[k:]) for k in range(len(text) + 1))
        return bool(text) and text[0] == pattern[0] and match(pattern[1:], text[1:])

    hits = [(len(p), allow) for allow, p in rules if p and match(p, path)]
    return max(hits)[1] if hits else True


@pytest.mark.parametrize("seed", range(3))
def test_random_rules(spark, seed):
    rnd = random.Random(seed)
    text = lambda n, letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
    answers, urls, want = [], [], {}
    for i in range(40):
        rules = [(rnd.random() < 0.5, "/" + text(4, "ab.*$?") + rnd.choice(["", "", "$", "*"])) for _ in range(rnd.randint(0, 6))]
        origin = f"https://h{i}.example"
        answers.append((origin, DAY, 200, "User-agent: *\r\n" + "\r\n".join(f"{'Allow' if a else 'Disallow'}: {p} # {p}" for a, p in rules)))
        for k in range(12):
            path = "/" + text(5, "ab.?$")
            urls.append((f"{i}-{k}", f"{origin.upper().replace('HTTPS', 'https')}{path}#x"))
            want[f"{i}-{k}"] = plain(rules, path)
    rows = robots.judged(spark.createDataFrame(urls, "id string, url string"), robots.rules_of(spark.createDataFrame(answers, ANSWER), "m")).collect()
    assert {r.id: r.allowed for r in rows} == want and len(set(want.values())) == 2


@pytest.mark.parametrize("seed", range(2))
def test_the_answer_in_force(spark, seed):
    rnd = random.Random(seed)
    hour = lambda h: DAY + dt.timedelta(hours=h)
    answers = [(f"o{rnd.randint(0, 3)}", hour(rnd.randint(0, 200))) for _ in range(25)]
    fetches = [(i, f"o{rnd.randint(0, 4)}", hour(rnd.randint(0, 220))) for i in range(300)] + [(300, "o1", None), (301, None, hour(3))]
    given = spark.createDataFrame([*answers, answers[0], ("o1", None)], "origin string, at timestamp")
    got = {r.i: r.at for r in robots.in_force(spark.createDataFrame(fetches, "i int, origin string, ts timestamp"), given).collect()}
    for i, o, ts in fetches:
        fit = [a for p, a in answers if p == o and ts and a <= ts and ts - a < dt.timedelta(hours=24)]
        assert got[i] == max(fit, default=None)
    assert robots.in_force(spark.createDataFrame(fetches, "i int, origin string, ts timestamp"), given.limit(0)).filter("at is not null").isEmpty()


def test_fetches_by_the_answer_in_force(spark):
    hour = lambda h: DAY + dt.timedelta(hours=h)
    answers = [(O, hour(0), 200, "User-agent: *\nDisallow: /x"), (O, hour(10), 503, None), (O, hour(11), 404, None)]
    fetches = [(1, O + "/x", hour(1)), (2, O + "/y", hour(2)), (3, O + "/y", hour(10)), (4, O + "/x", hour(12)), (5, O + "/x", hour(35)), (6, "mailto:x", hour(1))]
    rows = robots.fetches_judged(spark.createDataFrame(fetches, "i int, url string, ts timestamp"), spark.createDataFrame(answers, ANSWER), "m").collect()
    assert {r.i: r.allowed for r in rows} == {1: False, 2: True, 3: False, 4: True, 5: None, 6: False}


def test_a_busy_origin_is_cut_by_time(spark):
    df = robots.in_force(spark.range(10).select(F.lit(O).alias("origin"), F.timestamp_seconds("id").alias("ts")), spark.range(2).select(F.lit(O).alias("origin"), F.timestamp_seconds("id").alias("at")))
    assert re.search(r"hashpartitioning\(origin#\d+, _cell#\d+L", df._jdf.queryExecution().executedPlan().toString())
