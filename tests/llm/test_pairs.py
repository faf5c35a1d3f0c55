"""op1 HTML, op2 decontamination, op6 near duplicates, op10 repeated passages, against brute force."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from samples import ODD, prose

from corpusloom.llm import decontamination, html_text, neardup, substring_dedup, tables
from corpusloom.llm.words import hash_words, shingles


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_components(rows):
    sets, roots = {}, {}
    for i, t in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        roots[i] = i

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]:
                x, y = sorted((root(a), root(b)))
                roots[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_equal_brute_force(make, corpus):
    got = neardup.near_duplicates(make(corpus)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(corpus)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_buckets_are_compared_in_blocks(make, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    docs = make(corpus)
    table = tables.kept(neardup.sketched(docs), "t")
    nodes = table.where("n_shingles > 0").selectExpr("doc_id AS id", "bands")
    links = neardup.confirmed_links(docs, neardup.buckets(nodes), block=4)
    found = {r.node: r.component for r in tables.components(links).collect()}
    want = {i: c for i, (_, c) in brute_components(corpus).items()}
    assert {i: found.get(i, i) for i in want} == want


def test_near_duplicates_of_odd_rows(make):
    got = neardup.near_duplicates(make(ODD)).collect()
    assert len(got) == len(ODD)
    component = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert component[8] == 7 and component[1] == 1 and component[2] == 2
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert neardup.near_duplicates(make([])).count() == 0


def test_an_id_with_two_texts_joins_their_groups(make):
    a, b = " ".join(prose(1, 50)), " ".join(prose(2, 50))
    got = neardup.near_duplicates(make([(3, a), (5, a), (5, b), (9, b), (2, "kan lor")])).collect()
    assert {r.doc_id: r.component_id for r in got} == {3: 3, 5: 3, 9: 3, 2: 2}


def test_a_hub_is_split_over_tasks(spark, monkeypatch, request):
    """Both sides of the join back to a hub are plain shuffles of written rows."""
    request.getfixturevalue("make")
    for key, value in {"adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.skewJoin.skewedPartitionFactor": "1.01",
                       "adaptive.advisoryPartitionSizeInBytes": "4k", "autoBroadcastJoinThreshold": "-1",
                       "adaptive.coalescePartitions.enabled": "false"}.items():
        old = spark.conf.get(f"spark.sql.{key}")
        request.addfinalizer(lambda key=key, old=old: spark.conf.set(f"spark.sql.{key}", old))
        spark.conf.set(f"spark.sql.{key}", value)
    links = tables.kept(spark.range(1, 60_000, 1, 6).selectExpr("0L AS u", "id AS v"), "hub")
    for step in (tables._large_star, tables._small_star):
        df = step(links if step is tables._large_star else links.selectExpr("v AS u", "u AS v"))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" in plan
        if step is tables._large_star:
            assert "skew=true" in plan
    found = tables.components(links)
    assert found.count() == 59_999 and found.where("component <> 0").count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = both[:200], both[50:250]
    x, y = (neardup.fast_similarity_sketch(np.unique(s), 1200) for s in (a, b))
    assert abs((x == y).mean() - 150 / 250) < 0.06
    tiny = neardup.fast_similarity_sketch(both[:2], 300)
    assert (tiny != neardup.EMPTY).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (2, 1), (300, 200)]
    got = {r.node: r.component for r in tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[40] == 1 and got[159] == 100 and got[300] == 200
    assert tables.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, n=35):
    own = [words_of(t) for _, t in rows]
    count = Counter(tuple(w[p:p + n]) for w in own for p in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, own):
        cover = [False] * len(w)
        for p in range(len(w) - n + 1):
            if count[tuple(w[p:p + n])] > 1:
                cover[p:p + n] = [True] * n
        kept = [x for x, c in zip(w, cover) if not c]
        out.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("extra", ["plain", "odd"])
def test_repeats_equal_brute_force(make, corpus, extra):
    rows = corpus + ([(None if i is None else 1000 + i, t) for i, t in ODD] if extra == "odd" else [])
    rows += [(500, " ".join(["la"] * 80)), (501, " ".join(prose(77, 20) * 4))]
    got = substring_dedup.without_repeats(make(rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute_repeats(rows)
    for r in got:
        assert sum(s.end - s.start for s in r.repeats) == r.n_removed
        assert all(s.end - s.start >= 35 for s in r.repeats)


def test_rows_without_an_id_lose_parts_of_an_extension(make):
    base = prose(31, 90)
    rows = [(None, " ".join(prose(100, 20) + base[:60])), (None, " ".join(base[20:80] + prose(101, 9))),
            (7, " ".join(prose(102, 5) + base[30:90])), (None, " ".join(prose(103, 50))),
            (None, " ".join(prose(104, 70) + base[:36])), (None, "kan lor"), (None, " ".join(prose(105, 40))),
            (None, " ".join(prose(105, 40)))]
    got = substring_dedup.without_repeats(make(rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute_repeats(rows)
    assert sum(r.n_removed > 0 for r in got) == 6


def test_repeats_of_an_empty_table(make):
    assert substring_dedup.without_repeats(make([])).count() == 0


def item_shingles(text):
    w = [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_containment_equals_brute_force(make, spark):
    items = [(i, " ".join(prose(500 + i, 8 + 5 * i))) for i in range(14)]
    items += [(40, items[3][1]), (41, "kan lor"), (42, None), (None, items[2][1] + " x"), (43, " ".join(prose(9, 700)))]
    rows = []
    for i in range(60):
        own = prose(i, 30 + 40 * (i % 9))
        if i % 4 == 0:
            own[10:10] = items[i % 14][1].upper().split()
        if i % 7 == 0:  # an item in two halves, far apart
            half = items[i % 14][1].split()
            own = half[:len(half) // 2] + own * 5 + half[len(half) // 2 - 4:]
        if i % 11 == 0:
            own += items[13][1].split()[:-12]
        rows.append((i, ", ".join(own)))
    rows += [(100, items[-1][1]), (101, " ".join(items[-1][1].split()[60:])), (102, None), (None, items[5][1]), (103, "kan lor")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.shared for r in decontamination.contained_items(make(rows), bench).collect()}
    names = {}
    for i, t in sorted((x for x in items if x[0] is not None), key=lambda x: x[0]):
        if item_shingles(t):
            names.setdefault(frozenset(item_shingles(t)), i)
    want = {}
    for d, t in rows:
        own = item_shingles(t)
        for s, i in names.items():
            if 100 * len(s & own) >= 80 * len(s):
                want[(d, i)] = len(s & own)
    assert got == want and len(want) > 20
    classes = {r.item_id: r.class_id for r in decontamination.item_classes(bench).collect()}
    assert classes[40] == 3 and classes[3] == 3 and 41 not in classes
    left = decontamination.clean_documents(make(rows), bench)
    assert left.columns == make(rows).columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_items_of_few_shingles_are_always_found(make, spark):
    items = [(1, "kan lor mist tul rem"), (2, "sok van bel dor fin gal"), (3, " ".join(prose(800, 20)))]
    rows = []
    for i in range(900):
        own = [f"{w}{i}" for w in prose(i, 40)]
        text = items[i % 3][1].split()
        rows.append((i, " ".join(own[:20] + (text[:-3] if i % 3 == 2 else text) + own[20:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contained_items(make(rows), bench).collect()}
    assert got == {(i, i % 3 + 1) for i in range(900)}


def test_containment_of_odd_and_empty_tables(make, spark):
    bench = spark.createDataFrame([(1, "same text twice over and over again")], "item_id long, text string")
    got = decontamination.contained_items(make(ODD), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(7, 1), (8, 1)} and len(got) == 2
    assert decontamination.contained_items(make(ODD), bench.limit(0)).count() == 0
    assert decontamination.contained_items(make([]), bench).count() == 0
    assert decontamination.clean_documents(make(ODD), bench.limit(0)).count() == len(ODD)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="<p>no</p>";</script></head>
<body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li>News</ul></nav>
<div class="cookie-notice">We use cookies</div>{body}<footer>&copy; us</footer>"""


def test_markup_decides_inside_articles():
    body = """<main><article class="post"><h1>Title &amp; more</h1><p>First <b>part
      here.<p>Second<br>line &lt;x&gt;<form><input><p>subscribe</form><aside>side</aside>
      <ul><li>one<li>two</ul><div class="ad">buy</div><!-- <p>hidden --></article>
      <section id="comments"><p>nice</section></main>"""
    assert html_text.main_texts([PAGE.format(body=body)]) == ["Title & more\nFirst part here.\nSecond line <x>\none\ntwo"]


@pytest.mark.parametrize("attributes,kept", [
    ('style="overflow-x:hidden"', True), ('aria-hidden="false"', True), ('data-role="navigation"', True),
    ("title='the hidden role'", True), ('data-id="nav" data-class="ad"', True), ("title='a' role=main", True),
    ("hidden", False), ('aria-hidden="true"', False), ("ID = x ROLE=navigation", False), ('class="ad"', False),
])
def test_attributes_are_compared_by_whole_names(attributes, kept):
    page = f"<body><div {attributes}><p>kan lor mist</p></div></body>"
    assert html_text.main_texts([page]) == ["kan lor mist" if kept else ""]


def test_repeats_decide_where_markup_does_not():
    pages = [f"<body><div>Welcome to our site dear reader of all things</div><div><p>{' '.join(prose(i, 40))}</p></div>"
             f"<div>Read all the rules before you write to us</div></body>" for i in range(6)]
    assert html_text.main_texts(pages) == [" ".join(prose(i, 40)) for i in range(6)]
    # Copies of one page are one page: nothing in them is boilerplate.
    assert html_text.main_texts([pages[0]] * 5)[0].count("\n") == 2


def test_repeated_runs_equal_brute_force():
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 3, n) for n in (30, 5, 50, 40, 8, 60, 0)]
    count = Counter(x for x in {(s.tobytes(), tuple(s[p:p + 4])) for s in streams for p in range(len(s) - 3)})
    by_run = Counter(run for _, run in count)
    for s, cover in zip(streams, html_text.repeated(streams, depth=4, pages=3)):
        want = np.zeros(len(s), bool)
        for p in range(len(s) - 3):
            if by_run[tuple(s[p:p + 4])] >= 3:
                want[p:p + 4] = True
        assert (want == cover).all()


def test_pages_of_all_kinds(spark, make):
    make([])
    rows = [(i, f"https://H.example/{i}", PAGE.format(body=f"<article><p>{' '.join(prose(i, 20))}</p></article>")) for i in range(40)]
    rows += [(50, None, None), (51, "no url", ""), (52, "https://x/", "<"), (53, "https://x/", "<p>a<b"), (53, "https://x/", "<p>a<b"),
             (54, "https://y/", "<p>" + "q" * 100000 + '<a href="'), (None, "https://y/", "plain & simple"), (55, "https://y/", "<!-- open")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS part", "3 AS text")
    got = html_text.extracted_pages(df, group_pages=8).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert all(by_id[i] == " ".join(prose(i, 20)) for i in range(40))
    assert by_id[50] == by_id[51] == by_id[55] == "" and by_id[None] == "plain & simple" and by_id[53].startswith("a")
    assert html_text.extracted_pages(df.limit(0)).count() == 0


def test_the_size_of_a_host_changes_no_text(spark, make):
    make([])
    notice = "This part of the site is closed until further notice by us"
    plain = "<body>{}<div><p>{}</p></div></body>"
    rows = []
    for i in range(60):
        own = " ".join(prose(i, 30))
        first = f"<div>{notice}</div>" if i in (7, 28, 51) else f"<div>Seen on {i % 30} of two pages {' '.join(prose(900 + i % 30, 9))}</div>"
        if i in (3, 4):  # with markup, repeats of a menu on a page without
            rows.append((i, "https://h.example/a", f"<body><div>menu of all our old things and places</div><article>{own} x</article>"
                         f"<p>{i}</p></body>"))
        else:
            rows.append((i, "https://h.example/a", plain.format(first, own)))
    rows.append((90, "https://h.example/a", plain.format("<div>menu of all our old things and places</div>", "kan lor")))
    rows += [(100 + i, "https://small.example/", plain.format(f"<div>{notice}</div>", " ".join(prose(i, 20)))) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = [{r.page_id: r.text for r in html_text.extracted_pages(df, group_pages=g).collect()} for g in (5, 1000)]
    assert texts[0] == texts[1] and len(texts[0]) == len(rows)
    assert not any(notice in t for t in texts[0].values()) and "two pages" in texts[0][40]
    assert texts[0][90] == "kan lor"


def test_shingle_sets_match_the_words():
    h = hash_words([b"a b c d e a b c d"], fold=True).of(0)
    assert shingles(h, 4).size == 5
