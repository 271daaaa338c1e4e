"""Repair of damaged URLs: the same as comparing all, without comparing all."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from groundcheck.functions import text as T
from groundcheck.operators import references
from tests.test_plans import plan


def _repairs(spark):
    """Random URLs of few characters, known and damaged: (references, links)."""
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abc-%é"), n))
    links = [(f"a{n % 2}", f"http://x.org/{word(rng.integers(0, 9))}") for n in range(120)] + [("a0", None), ("a1", "x")]
    refs = [(f"a{n % 3}", str(n), "".join(c for c in links[n % 120][1] if rng.random() > 0.06 * (n % 4))) for n in range(240)] + [("a0", "n", None), ("a1", "e", ""), ("a1", "m", "-")]
    return spark.createDataFrame(refs, "answer_id string, id string, raw_url string"), spark.createDataFrame(links, "answer_id string, url string")


def test_repair_equals_comparing_all(spark):
    refs, links = _repairs(spark)
    key = lambda c: T.fuzzy_url_key(F.col(c))
    keys = {r["u"]: r["k"] for r in refs.select(F.col("raw_url").alias("u")).union(links.select("url")).distinct().withColumn("k", key("u")).collect()}
    known = links.distinct().collect()

    def stands(short: str, long: str) -> bool:
        rest = iter(long)
        return all(c in rest for c in short)

    gaps, got = set(), {r["id"]: r["url"] for r in references.mended(refs, links).collect()}
    for r in refs.collect():
        k, url = keys[r["raw_url"]], r["raw_url"]
        if k is not None:
            each = [(len(o) - len(k), u) for a, u in known if a == r["answer_id"] and (o := keys[u]) is not None and 0 <= len(o) - len(k) <= 5 and stands(k, o)]
            gaps.add(min(each)[0] if each else -1)
            url = min(each)[1] if each else url
        assert got[r["id"]] == url
    assert gaps >= {-1, 0, 1, 2, 3}


def test_repair_compares_no_answer_as_a_whole(spark):
    text = plan(references.mended(*_repairs(spark)))
    joins = re.findall(r"(?:Join|JoinExec) \[([^\]]*)\], \[[^\]]*\], Inner", text)
    assert joins and all("," in keys for keys in joins)  # by answer and something else
