import fnmatch
import random
import re

import numpy as np

from chronoweave.llm import url_filter


def test_globs_against_regular_expressions():
    rng = random.Random(4)
    patterns = ["".join(rng.choice("ab*?.") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    patterns += ["**", "", "*", "a**b", "x" * 150 + "*", "*" + "y" * 70 + "?z"]
    texts = ["".join(rng.choice("ab.\0") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += ["x" * 150, "x" * 149, "q" + "y" * 70 + "az", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    hit = url_filter.Machine.build(patterns).accepts(data, offsets)
    for k, p in enumerate(patterns):
        parts = re.split(r"(\*\*+|\*|\?)", p)
        expr = "".join("(?s:.*)" if x.startswith("**") else "[^\0]*" if x == "*" else "[^\0]" if x == "?" else re.escape(x) for x in parts)
        assert hit[:, k].tolist() == [bool(re.fullmatch(expr, t)) for t in texts], p
    assert fnmatch.fnmatch("ab", "a*")


def slow(url):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    bad = any(b.strip("*\0") in host for b in url_filter.BLOCK_GLOBS)
    return host, path, best and best[0], best[1] if best else "block" if bad else "allow"


URLS = [
    None, "", "no scheme.example.org/es/x", "http://example.org/es/a", "http://EXAMPLE.org/es", "https://sub.Example.ORG/en/12?x=1#y",
    "http://x.com/fr/", "http://x.com/de/1", "http://com/fr/a", "http://notexample.org/es/", "http://org", "http://org/", "ftp://a.b.net?q=/es/",
    "http://www.cheap-pills.example.net/de/1", "http://www.cheap-pills.example.com/fr/1", "http://h#f/://", "a://b://c.org/x",
    "http://a.org\u00e9/\u00e9\u00e8?", "http://a.net/" + "long/" * 5000, "http://x.com/en/example.org/es/", "http://a.net/x\ny.org/z",
]


def test_rules_and_urls_by_hand(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS)] + [(None, URLS[3], ""), (3, URLS[3], "")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *slow(u)) for i, u, _ in rows), key=repr)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
