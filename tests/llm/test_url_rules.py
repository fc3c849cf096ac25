import random
from itertools import combinations

from glossa.llm import url_rules as U
from glossa.llm.labelled import held_out
from glossa.llm.queries import FIXED_RULES


def slow_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = path = ""
    state = 0
    for c in rest:
        if state == 0 and c in "/?#":
            state = 1
        if state == 0:
            host += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif c in "?#":
            break
        else:
            path += c
    return host, path


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/en/1", "http://example.org/es/x?y", "https://a.b.example.org/en/12#z",
    "http://x.com/fr/", "http://x.com/FR/", "http://notorg/", "http://org/", "http://com/de/1", "http://xcom/de/1", "http://ÀB.com/de/", "a://b://c/d",
    "http://h?x=/org/", "http://x.net/#a?b", "http://org.", "http://example.org/esx",
]


def test_fixed_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[4]), (3, URLS[3])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as id")
    got = U.judge(df, FIXED_RULES, []).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = slow_host_path(r.url)
        fits = []
        for verdict, rule in FIXED_RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), rule, verdict))
        _, rule, verdict = max(fits) if fits else (0, None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), r
    assert U.judge(df.limit(0), FIXED_RULES, []).count() == 0


def brute_rules(transactions, support, least, confidence):
    n, need = len(transactions), max(support, least / len(transactions)) * len(transactions)
    items = sorted({t for x in transactions for t in x if not t.startswith("label:")})
    out = []
    for k in (1, 2, 3):
        for c in combinations(items, k):
            have = [x for x in transactions if x.issuperset(c)]
            low = [x for x in have if U.LOW in x]
            if len(low) >= need and len(low) / len(have) >= confidence:
                out.append((c, len(low) / len(have)))
    return [(c, s) for c, s in out if not any(set(d) < set(c) and t >= s for d, t in out)]


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(2)
    pages, labels = [], []
    for i in range(600):
        host, lang = rng.choice(["pills", "news", "blog"]), rng.choice(["en", "de"])
        pages.append((i, f"http://{host}.net/{lang}/{i}"))
        low = rng.random() < (0.9 if (host, lang) == ("pills", "de") else 0.1)
        labels.append((i, int(not low), 0))
    p = spark.createDataFrame(pages, "page_id long, url string")
    ls = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trained = {r.doc_id for r in ls.where(~held_out("doc_id")).collect()}
    sets = [{*U.tokens(u), U.HIGH if q else U.LOW} for (i, u), (_, q, _) in zip(pages, labels, strict=True) if i in trained]
    rules = U.mine(p, ls)
    small = [(c, s) for c, s in rules if len(c) <= 3]
    places = {}
    for t in {t for x in sets for t in x if not t.startswith("label:")}:
        places.setdefault(tuple(t in x for x in sets), []).append(t)
    stands = {max(ts, key=lambda t: (len(t), t)) for ts in places.values()} | {U.LOW, U.HIGH}
    want = brute_rules([x & stands for x in sets], U.SUPPORT, U.LEAST, U.CONFIDENCE)
    assert {(c, round(s, 9)) for c, s in small} == {(c, round(s, 9)) for c, s in want} and want
    verdicts = {r.page_id: r.verdict for r in U.judge(p, [], rules).collect()}
    assert {i for i, v in verdicts.items() if v == "block"} == {i for i, u in pages if "pills" in u and "/de/" in u}
    assert U.mine(p, ls.limit(0)) == [] and U.mine(p.limit(0), ls) == []


def test_index_finds_what_a_scan_finds():
    rng = random.Random(4)
    words = [U.tokens(f"http://h{i % 7}.net/{'abc'[i % 3] * 2}/{i}.html?k{i % 5}=1") for i in range(40)]
    rules = [(tuple(rng.sample(w, rng.randrange(1, 4))), rng.random()) for w in words]
    index = U.MinedRules(rules)
    for i in range(120):
        url = f"http://h{i % 9}.net/{'abcd'[i % 4] * 2}/{i}.html?k{i % 6}=1"
        have = set(U.tokens(url))
        assert index.confidence(url) == max((s for c, s in rules if have.issuperset(c)), default=None)


def test_redundant_rules_do_not_push_out_less_sure_ones(spark, monkeypatch):
    monkeypatch.setattr(U, "RULES", 50, raising=False)
    pages, labels = [], []
    for i in range(900):
        host = ("cheap.pills.one.net/a", "spam.two.org/b", "news.three.com/c")[i % 3]
        low = (True, i % 10 < 8, False)[i % 3]
        pages.append((i, f"http://{host}/{i}"))
        labels.append((i, int(not low), 0))
    p = spark.createDataFrame(pages, "page_id long, url string")
    rules = U.mine(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    verdicts = {r.page_id: r.verdict for r in U.judge(p, [], rules).collect()}
    assert {i for i, v in verdicts.items() if v == "block"} == {i for i, _ in pages if i % 3 < 2}


def test_tokens_of_one_host_are_one(spark):
    """A host of many labels and words gives one rule, not one for each of their sets."""
    pages = [(i, f"http://a.b.c.d.e.f.pills.net/cheap/best/{i}" if i % 2 else f"http://news.org/x/{i}") for i in range(200)]
    ls = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    p = spark.createDataFrame(pages, "page_id long, url string")
    rules = U.mine(p, ls)
    assert rules == [(("host:a.b.c.d.e.f.pills.net",), 1.0)]
    assert {r.decided_by for r in U.judge(p, FIXED_RULES, rules).collect()} == {"fixed", "mined"}
    assert U.host_and_path("http://h/" + "x" * 10**6) == ("h", "/" + "x" * 10**6) and U.judge(spark.createDataFrame([(1, "http://h/" + "x" * 10**6)], p.schema), [], rules).count() == 1
