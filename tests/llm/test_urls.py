import math
import random
import re
from collections import Counter, defaultdict

from shoptide.llm import urls
from shoptide.llm.queries import op6_urls
from tests.llm.data import FOLDER


def plain(url, rules=urls.RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, (max(fits)[1:] if fits else (None, None))


def pages(spark, found):
    return spark.createDataFrame([(i, u, "x", "y", 1) for i, u in enumerate(found)], "page_id long, url string, host string, template string, n int")


def shape(segment):
    return "end" if segment is None else next((name for name, pattern in urls.SHAPES if re.search(pattern, segment)), "word")


def z(g, df):
    return ((g / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))


def merged_branches(branches, limit=1.645):
    """``branches`` {segment: Counter of what follows and labels}: the name of each that is merged."""
    def cells(counts, test):
        return {c: n for c, n in counts.items() if (c in ("blocked", "allowed")) == test}

    kinds = {here: max(((n, c) for c, n in cells(counts, False).items()))[1].removeprefix("follows ") for here, counts in branches.items()}
    alike = defaultdict(list)
    for here, kind in kinds.items():
        differs = False
        for test in (False, True):
            own, pool = cells(branches[here], test), Counter()
            for other, counts in branches.items():
                if kinds[other] == kind:
                    pool.update(cells(counts, test))
            g = 2 * sum(n * math.log(n * sum(pool.values()) / (sum(own.values()) * pool[c])) for c, n in own.items())
            differs |= bool(own) and len(pool) > 1 and z(max(g, 0.0), len(pool) - 1) > limit
        if not differs:
            alike[kind].append(here)
    return {here: f"{{before {kind}}}" for kind, some in alike.items() if len(some) > 1 for here in some}


def plain_templates(paths, least_pages=5, min_values=5, max_share=0.2, word_values=50):
    """``paths`` {(host, path): (n, blocked, allowed)}: the template of each, node by node."""
    out = {}

    def descend(host, template, level, rows):
        """``rows``: (path, segments) of one node."""
        deeper = [r for r in rows if len(r[1]) > level]
        out.update({(host, path): template for path, parts in rows if len(parts) <= level})
        if not deeper:
            return
        if len(deeper) < 2 or sum(paths[host, path][0] for path, _ in deeper) < least_pages:
            out.update({(host, path): template + "/{rest}" for path, _ in deeper})
            return
        values, branches = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
        for path, parts in deeper:
            n, blocked, allowed = paths[host, path]
            values[shape(parts[level])][parts[level]] += n
            counts = branches[parts[level]]["all"]
            counts["follows " + shape(parts[level + 1] if len(parts) > level + 1 else None)] += n
            counts.update({k: v for k, v in (("blocked", blocked), ("allowed", allowed)) if v})
        wild = {s for s, found in values.items() if len(found) >= (word_values if s == "word" else min_values)
                and max(found.values()) <= max(2.0, max_share * sum(found.values()))}
        merged = merged_branches({here: b["all"] for here, b in branches.items() if shape(here) not in wild})
        children = defaultdict(list)
        for path, parts in deeper:
            here = parts[level]
            children[template + "/" + (f"{{{shape(here)}}}" if shape(here) in wild else merged.get(here, here))].append((path, parts))
        for name, some in children.items():
            descend(host, name, level + 1, some)

    hosts = defaultdict(list)
    for host, path in paths:
        hosts[host].append((path, [s for s in path.split("/") if s]))
    for host, rows in hosts.items():
        descend(host, "", 0, rows)
    return out


def plain_judge(found, rules=urls.RULES, purity=0.9, min_labels=5, weight=2.0):
    """(host, path, rule, verdict, template) of each url."""
    parsed = [plain(u, rules) for u in found]
    paths = defaultdict(lambda: [0, 0, 0])
    for host, path, (_, verdict) in parsed:
        paths[host, path][0] += 1
        paths[host, path][1] += verdict == "block"
        paths[host, path][2] += verdict == "allow"
    names = plain_templates(paths)
    at, by_host = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for key, (_, blocked, allowed) in paths.items():
        for counts in (at[key[0], names[key]], by_host[key[0]]):
            counts[0] += blocked
            counts[1] += allowed
    b, a = (sum(c[k] for c in by_host.values()) for k in (0, 1))
    overall = (b + 1) / (b + a + 2)
    out = []
    for host, path, (rule, verdict) in parsed:
        (b, a), (hb, ha) = at[host, names[host, path]], by_host[host]
        smoothed = (b + weight * (hb + weight * overall) / (hb + ha + weight)) / (b + a + weight)
        out.append((host, path, rule, verdict or ("block" if b + a >= min_labels and smoothed >= purity else "allow"), names[host, path]))
    return out


def judged(df):
    return [(r.host, r.path, r.rule, r.verdict, r.template) for r in df.orderBy("page_id").collect()]


def test_query_equals_a_plain_version(spark):
    given = [r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").orderBy("page_id").collect()]
    assert judged(op6_urls(spark, FOLDER)) == plain_judge(given)


def test_made_pages_equal_a_plain_version(spark):
    rng = random.Random(3)
    rules = (("block", "a.com", "/shop/item/1"), ("block", "a.com", "/x/"), ("allow", "a.com", "/news/"), ("block", "b.org", "/"), ("allow", "b.org", "/ok/"))
    parts = ["shop", "item", "news", "x", "ok", "2024-01", "p7", "deadbeef01", "9.html"]
    found = [f"http://{rng.choice(['a.com', 'b.org', 'c.net', 'w.b.org'])}/" + "/".join(
        rng.choice([*parts, str(rng.randrange(300)), f"n{rng.randrange(20)}"]) for _ in range(rng.randrange(7))) for _ in range(1500)]
    found += [f"http://a.com/shop/item/{n}" for n in range(100, 340)]
    want = plain_judge(found, rules)
    assert judged(urls.judge(pages(spark, found), rules)) == want
    assert {v for _, _, rule, v, _ in want if rule is None} == {"allow", "block"}


def test_unlabelled_branches_share_the_verdict_of_those_like_them(spark):
    rules = (("block", "s.com", "/spam/"), ("block", "s.com", "/junk/"), ("allow", "t.com", "/spam/"))
    found = [f"http://s.com/{kind}/{n}" for kind in ("spam", "junk", "trash") for n in range(30)] + [f"http://t.com/{kind}/{n}" for kind in ("spam", "trash") for n in range(30)]
    result = dict(zip(found, judged(urls.judge(pages(spark, found), rules))))
    assert result["http://s.com/trash/7"][2:4] == (None, "block") and result["http://t.com/trash/7"][2:4] == (None, "allow")


def test_deep_paths_are_told_apart(spark):
    rules = (("block", "d.com", "/a/b/c/d/e/f/bad/1"), ("allow", "d.com", "/a/b/c/d/e/f/good/1"))
    found = [f"http://d.com/a/b/c/d/e/f/{kind}/{n}" for kind in ("bad", "good") for n in range(100, 300)]
    result = dict(zip(found, judged(urls.judge(pages(spark, found), rules))))
    assert result["http://d.com/a/b/c/d/e/f/bad/250"][2:4] == (None, "block") and result["http://d.com/a/b/c/d/e/f/good/250"][2:4] == (None, "allow")


def test_templates_with_blocked_labels_are_rejected(spark):
    rules = (("block", "shop.com", "/item/1"), ("allow", "shop.com", "/news/"))
    found = [f"http://shop.com/item/{n}" for n in range(100, 200)] + [f"http://shop.com/item/{n}" for n in range(300, 340)]
    found += [f"http://shop.com/news/{n}" for n in range(50)] + ["http://shop.com/about", "http://other.com/item/5"]
    result = {u: r for u, r in zip(found, urls.judge(pages(spark, found), rules).orderBy("page_id").collect())}
    assert result["http://shop.com/item/300"].template == result["http://shop.com/item/100"].template == "/item/{number}"
    assert result["http://shop.com/item/300"].verdict == "block" and result["http://shop.com/item/300"].rule is None
    assert result["http://shop.com/news/7"].verdict == result["http://shop.com/about"].verdict == result["http://other.com/item/5"].verdict == "allow"
    assert result["http://shop.com/item/300"].template_purity > 0.9


def test_branches_that_are_alike_are_merged_and_others_are_not(spark):
    found = [f"http://a.com/{s}/{n}" for s in ("red", "blue") for n in range(40)] + [f"http://a.com/docs/{w}/x/{n}" for w in ("p", "q") for n in range(20)]
    result = dict(zip(found, urls.judge(pages(spark, found), ()).orderBy("page_id").collect()))
    assert result["http://a.com/red/1"].template == result["http://a.com/blue/2"].template
    assert result["http://a.com/docs/p/x/1"].template != result["http://a.com/red/1"].template


def test_odd_urls(spark):
    found = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.Org/es/1?x#y", "http://notexample.org/es/1", "ftp://ÀB.com?q", "http://a.com//b//", "http://h#f",
             "http://x.com/" + "/".join(f"s{i}" for i in range(500)), "a://b://c/d", "http://example.org/en/1", "http://example.org/en/1", "http://x.com/a\nb"]
    result = urls.judge(pages(spark, found)).orderBy("page_id").collect()
    assert len(result) == len(found)
    for url, r in zip(found, result):
        host, path, (rule, verdict) = plain(url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert urls.judge(pages(spark, [])).count() == 0
