import random

from verdigris.llm import urls


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])
    rest = rest[:cut]
    host, path = (rest[: rest.index("/")], rest[rest.index("/") :]) if "/" in rest else (rest, "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len) if fits else None


def test_hosts_paths_and_rules(spark):
    r = random.Random(1)
    parts = ["http://", "https://", "WWW.", "a.", "example.", "com", "net", "org", "/", "en/", "de/", "es/", "7", "8", "?", "#", "x", "É", "://"]
    pool = [None, "", "no scheme", "http://com/en/", "http://com", "ftp://A.COM/en/1?x#y"] + ["".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(pool)], "page_id long, url string, host string")
    verdicts = dict(urls.RULES)
    got = urls.filter_urls(pages, urls.RULES, urls.labelled_urls()).collect()
    assert len(got) == len(pool)
    for g in got:
        host, path, rule = brute(g["url"])
        assert (g["host"], g["path"], g["rule"]) == (host, path, rule), g["url"]
        assert g["verdict"] == verdicts[rule] if rule else g["verdict"] in ("allow", "block")
    assert urls.filter_urls(pages.limit(0), urls.RULES, []).count() == 0


def test_held_out_accuracy():
    rows = urls.labelled_urls()
    random.Random(2).shuffle(rows)
    cut = len(rows) * 3 // 4
    model = urls.UrlClassifier(rows[:cut])
    assert sum((model.score(*urls.split_url(u)) >= urls.BLOCK_FROM) == bool(y) for u, y in rows[cut:]) >= 0.95 * (len(rows) - cut)


def test_held_out_words():
    """Every word, and with it every host, stands on one side only: in turn a fifth of all words is judged by a model that has met none of them."""
    rows = urls.labelled_rows()
    words = sorted(set().union(*(w for _, _, w in rows)))
    random.Random(9).shuffle(words)
    right, count = [0, 0], [0, 0]
    for fold in range(5):
        held = set(words[fold::5])
        model = urls.UrlClassifier([(u, y) for u, y, w in rows if not w & held])
        for u, y, w in rows:
            if w <= held:
                count[y] += 1
                right[y] += (model.score(*urls.split_url(u)) >= urls.BLOCK_FROM) == bool(y)
    assert right[0] >= 0.85 * count[0] and right[1] >= 0.55 * count[1], (right, count)  # as built: 119 of 133, 47 of 76


def test_long_urls_ties_and_repeats(spark):
    """Urls are read whole, the first of tied rules wins, repeated rows are judged alike, clashing columns are replaced."""
    long = "http://a.example.net/" + "x" * 300_000 + "/casino"
    rules = [("a.example.net/x", "allow"), ("A.example.net/x", "block")]
    pages = spark.createDataFrame([(1, long, 5), (1, long, 5), (2, "http://b.net/", 5)], "page_id long, url string, verdict int")
    got = urls.filter_urls(pages, rules, urls.labelled_urls()).orderBy("page_id").collect()
    assert [len(g["path"]) for g in got] == [300_008, 300_008, 1] and got[0] == got[1]
    assert (got[0]["rule"], got[0]["verdict"], got[2]["rule"]) == ("a.example.net/x", "allow", None)
