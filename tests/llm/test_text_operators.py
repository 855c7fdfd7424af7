"""Extraction, rules, classifiers, joins and dedup against brute force, on small fixtures and the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from lodestone.llm import fm_index, language, line_rules, ngram_join, site_style, substring_dedup, toxicity
from lodestone.llm.common import Scratch, load
from pyspark.sql import functions as F


def words(text):
    return (text or "").encode().split()


# 1 ------------------------------------------------------------------------------------------------------------------


def test_extraction(spark):
    nav = "<nav><a href=/x>Menu</a></nav>"
    pages = [
        (1, "http://h.example/a", f"<html><body>{nav}<div class='ad'>Buy</div><article><h1>T</h1><p><b>A &amp; b<br>c<p>D</article><footer>f</footer>"),
        (2, None, None),
        (3, "http://h.example/b", ""),
        (4, "x", "<p>just text <script>var a='<p>'</script>here<!-- no -->"),
        (5, "http://h.example/c", "<main><ul><li>i<li>j</ul><aside>s</aside><section id=comments><p>c</p></section></main>"),
        (5, "http://h.example/c", "<main>again</main>"),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in site_style.extract(spark, df).collect())
    assert got == [(1, "T\n\nA & b c\n\nD", 13), (2, "", 0), (3, "", 0), (4, "just text here", 14), (5, "again", 5), (5, "i\n\nj", 4)]
    assert site_style.extract(spark, df.limit(0)).count() == 0


def test_template_branches_go(spark):
    """A division without a telling name, the same on all pages of a host, is removed; on few pages it stays."""
    page = lambda h, k: (k, f"http://{h}/{k}", f"<body><div class='q7'>Welcome to this site</div><div class='z1'>Story {k} {h} is told</div></body>")
    df = spark.createDataFrame([page("big.example", k) for k in range(30)] + [page("small.example", k) for k in range(100, 103)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_style.extract(spark, df).collect()}
    assert got[3] == "Story 3 big.example is told"
    assert got[101] == "Welcome to this site\n\nStory 101 small.example is told"
    tree = site_style.style_tree(spark, df.select(site_style.host_of("url").alias("host"), "html"), Scratch(spark, "tree")).where("host = 'big.example' and content is not null").collect()
    assert sorted(round(r.content, 6) for r in tree) == [0.0, 1.0]


def brute_tree(pages):
    """Nodes of one host by their names: (own importance, composite, highest composite of the branch), from plain dictionaries."""
    texts, seqs, seen = defaultdict(list), defaultdict(list), defaultdict(set)
    for k, page in enumerate(dict.fromkeys(pages)):
        for path, kids, own in page:
            seen[path].add(k)
            seqs[path].append((k, kids))
            texts[path] += [(k, t) for t in own]
    out = {}
    for path, on in seen.items():
        m = math.log(max(len(on), 2))
        c = Counter(s for _, s in set(seqs[path]))
        n = sum(c.values())
        shown = -sum(v / n * math.log(v / n) for v in c.values()) / m
        t = Counter(t for _, t in set(texts[path]))
        if t:
            content = max(0, 1 - sum(map(math.log, t.values())) / (len(t) * m))
            out[path] = 0.9 * (1 - (1 - content) * len(on) / (len(on) + 1)) + 0.1 * shown
        else:
            out[path] = shown
    below = {p: [(q, q.count("/") - p.count("/")) for q in out if (q + "/").startswith(p + "/")] for p in out}
    weigh = lambda q, d: len(seen[q]) * 0.9**d
    comp = {p: sum(weigh(q, d) * out[q] for q, d in qs) / sum(weigh(q, d) for q, d in qs) for p, qs in below.items()}
    return {p: (out[p], comp[p], max(comp[q] for q, _ in below[p])) for p in out}


def test_tree_against_brute_force(spark):
    """Entropies, composite importance and the branches that go, on a host with a menu and a share box without telling names."""
    body = lambda k: f"<body><div class=q><ul><li>One<li>Two</ul></div><div class=z><h1>H{k}</h1><p>Text {k}{'<p>More' if k % 2 else ''}</p></div></body>"
    plain = lambda k: (
        ("/body", "div.q|div.z", ()), ("/body/div.q", "ul", ()), ("/body/div.q/ul", "li", ()), ("/body/div.q/ul/li", "", ("One", "Two")),
        ("/body/div.z", "h1|p", ()), ("/body/div.z/h1", "", (f"H{k}",)), ("/body/div.z/p", "", (f"Text {k}", "More") if k % 2 else (f"Text {k}",)),
    )
    df = spark.createDataFrame([(k, f"http://h/{k}", body(k % 9)) for k in range(12)], "page_id long, url string, html string")
    want = {site_style.path_key(p): v for p, v in brute_tree([plain(k % 9) for k in range(12)]).items()}
    tree = site_style.style_tree(spark, df.select(site_style.host_of("url").alias("host"), "html"), Scratch(spark, "tree"))
    got = {r.path: (r.importance, r.composite, r.most) for r in tree.collect()}
    assert set(got) == set(want)
    for p, v in want.items():
        assert got[p] == pytest.approx(v)
    assert [r.removed for r in site_style.removed_branches(tree).collect()] == [[site_style.path_key("/body/div.q")]]
    texts = {r.page_id: r.text for r in site_style.extract(spark, df).collect()}
    assert texts[1] == "H1\n\nText 1\n\nMore" and texts[2] == "H2\n\nText 2"


def test_scripts_forms_and_class_names():
    """Raw elements end at their own closing tag only; a branch with most of the page isn't dropped for a word in its name."""
    text = site_style.main_text
    assert text("<article><p>a</p><script>for(i=0;i<n;i++){x()}</script><p>b is the article body</p></article>") == "a\n\nb is the article body"
    assert text("<body><script>if (i<n) { s = '>'; }</script><p>t</p>") == "t"
    assert text("<article class='comment-guide'><p>Guide text</p></article>") == "Guide text"
    assert text("<section class='search'><p>Search theory</p></section>") == "Search theory"
    assert text("<div id='social-history'>History</div>") == "History"
    assert text("<form><nav>m</nav><p>Body of the page</p><input></form>") == "Body of the page"
    assert text("<main><p>A story of some length</p><form>Your mail</form><div class='related-posts'>Other</div></main>") == "A story of some length"
    assert text("<p>a <span class='ad'>x</span>b</p>") == "a b"
    assert text("<style>p{}") == text("<title>x</title>") == ""


def test_small_hosts_are_judged(spark):
    """Shared texts go on hosts of a few pages too; copies of one page are no evidence."""
    page = lambda h, k, j: (k, f"http://{h}/{k}", f"<body><div class='q7'>Welcome to this site</div><div class='z1'>Story {j} {h} is told</div></body>")
    rows = [page("four.example", k, k) for k in range(4)] + [page("nine.example", k, k) for k in range(10, 19)] + [page("copies.example", k, k % 3) for k in range(20, 50)]
    got = {r.page_id: r.text for r in site_style.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "Story 2 four.example is told" and got[11] == "Story 11 nine.example is told"
    assert got[21] == "Welcome to this site\n\nStory 0 copies.example is told" and len(got) == 43


def test_articles_that_hold_little(spark):
    """Cards in <article> don't replace a story outside; a story in <article> stands alone."""
    story = "A long story that is told in a division of its own, with many words."
    page = f"<body><div class='z1'>{story}</div><article class=card><a href=/x>Other news</a></article></body>"
    assert site_style.main_text(page, set()) == f"{story}\n\nOther news"
    assert site_style.main_text(page.replace(story, "Short").replace("Other news", story), set()) == story


# 4 ------------------------------------------------------------------------------------------------------------------


def brute_rules(rows, line_docs, share, left):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.translate(lower))).strip(" ")
    hosts, seen = Counter(s for _, s, _ in rows), Counter()
    for key in {(s, norm(x), d, t) for d, s, t in rows for x in (t or "").split("\n") if words(x)}:
        seen[key[:2]] += 1
    out = []
    for d, s, t in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        gone = sum(len(words(x)) for x in lines if seen[s, norm(x)] > line_docs and seen[s, norm(x)] > share * hosts[s])
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out.append((d, len(w), sum(len(x.decode()) for x in w), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), len(hit), failed, not failed and not len(w) - gone < left * len(w)))
    return sorted(out)


def test_line_rules(spark, odd, none):
    abc = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    texts = [("a" if k % 3 else "b", f"Boiler plate {k % 2} line\n" + " ".join(abc(k) + abc(j) for j in range(60 if k % 4 else 20)) + "\nSee  PAGE 12 of all\n" * (1 + k % 5)) for k in range(60)]
    rows = [(k, s, t) for k, (s, t) in enumerate(texts)]
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    pick = lambda df: sorted(tuple(r[c] for c in cols) for r in df.collect())
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = pick(line_rules.line_rules(df, 5, 0.1, 0.8))
    assert got == brute_rules(rows, 5, 0.1, 0.8)
    assert len({r[-1] for r in got if not r[-2]}) == 2
    own = [(r.doc_id, r.source, r.text) for r in odd.dropDuplicates(["doc_id"]).collect()]
    assert pick(line_rules.line_rules(odd.dropDuplicates(["doc_id"]))) == brute_rules(own, 20, 0.01, 0.3)
    assert line_rules.line_rules(odd).count() == 12
    assert line_rules.line_rules(none).count() == 0


def test_line_rules_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(line_rules.LINE_RULES_SQL).df()
    got = line_rules.line_rules(load(spark, sf, "documents")).drop("text_key").toPandas()
    c = sorted(want.columns)
    assert sorted(got.columns) == c
    assert got[c].sort_values("doc_id").values.tolist() == want[c].sort_values("doc_id").values.tolist()


def test_line_rules_stay_native(spark, odd):
    plan = line_rules.line_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_frequent_lines_go(spark, odd):
    """Kept texts lose the lines above the limits and nothing else, as many words as line_rules counts."""
    own = lambda k: " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60))
    text = lambda k: f"Share  page {k}\n{own(k)}\n\nSee all news\n tail {own(k)[:4]} \nshare PAGE 7\n" if k % 2 else f"{own(k)}\nSee all news"
    rows = [(k, text(k), "en", "a", len(text(k)), "more") for k in range(30)] + [(100 + k, text(k), "en", None if k else "b", 1, "more") for k in range(3)]
    rows += [(200, "See all news\n" * 60 + own(80), "en", "a", 1, "more"), (201, "See all news", "en", "a", 1, "more")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    out = line_rules.clean(df, Scratch(spark, "clean"), 5, 0.1, 0.3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == df.columns and not re.search("Python|Pandas|Arrow", plan)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {*range(30), 100, 101, 102}
    for k in range(30):
        want = f"{own(k)}\n\n tail {own(k)[:4]} \n" if k % 2 else own(k)
        assert (got[k].text, got[k].n_chars) == (want, len(want))
    assert all((got[100 + k].text, got[100 + k].n_chars) == (text(k), 1) for k in range(3))
    for r in line_rules.line_rules(df, 5, 0.1, 0.3).where("kept").collect():
        assert len(words(got[r.doc_id].text)) == r.n_words - r.n_frequent_words
    assert line_rules.clean(odd, Scratch(spark, "clean"), 5, 0.1, 0.3).columns == odd.columns


def test_equal_rows_count_their_own_words(spark):
    """A row that is given twice has the same numbers as if given once."""
    own = " ".join(f"w{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(60))
    rows = [(k, "a", "\n".join(["one two three four five six seven eight"] * 4 + [f"{own} x{chr(97 + k)}"])) for k in range(10)]
    df = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, source string, text string")
    got = sorted((r.doc_id, r.n_frequent_words, r.n_frequent_lines, r.kept) for r in line_rules.line_rules(df, 5, 0.1, 0.3).collect())
    assert got == sorted((k, 32, 1, True) for k in [*range(10), 3, 3])


# 5 and 9 ------------------------------------------------------------------------------------------------------------


def held(r, m, k):
    return zlib.crc32(str(r).encode()) % m == k


def test_language(spark, odd, none):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in language.language_query(spark, docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and all(got[r.doc_id].held_out == held(r.doc_id, 5, 0) for r in rows)
    test = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in test) >= 0.98 * len(test)
    langs, table = language.learn(spark, docs)
    pred = {r.doc_id: r for r in language.identify(spark, odd, langs, table).collect()}
    assert [pred[d].lang_pred for d in (1, 2, 3, 10)] == ["und"] * 4 and pred[4].lang_pred in langs
    assert language.identify(spark, none, langs, table).count() == 0
    assert {r.lang_pred for r in language.language_query(spark, odd.where("lang is null")).collect()} == {"und"}


def test_filters_hold_all_their_grams(spark):
    df = spark.createDataFrame([("aa", "abcdefgh " * 5), ("bb", "zyxwvuts " * 5)], "lang string, text string")
    langs, table = language.learn(spark, df, slots=1 << 12)
    assert langs == ["aa", "bb"]
    got = language.identify(spark, spark.createDataFrame([(1, "abcdefgh abcdefgh"), (2, "zyxwvuts")], "doc_id long, text string"), langs, table).collect()
    assert [(r.lang_pred, r.coverage > 0.9) for r in sorted(got)] == [("aa", True), ("bb", True)]


def test_toxicity(spark, odd, none):
    bad = ["grobian", "lumpazi"]
    rows = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(30)) + (f" {bad[k % 2]}{'sch' * (k % 3)} x" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k, _, t in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_query(spark, docs, labels).collect()}
    test = [(k, t) for k, _, t in rows if held(k, 3, 1)]
    assert all(got[k].held_out for k, _ in test)
    assert all(got[k].predicted == t for k, t in test)
    assert all(0 <= r.score <= 1 for r in got.values())
    model = toxicity.learn(spark, docs, labels.limit(0))
    assert 0 < toxicity.score(spark, odd, model).first().score < 1
    assert toxicity.toxicity_query(spark, odd, labels.withColumn("toxic", F.lit(1))).count() == 12
    assert toxicity.toxicity_query(spark, none, labels).count() == 0


def test_toxicity_against_brute_force(spark):
    """Features, log-count ratios and scores of a small model, recomputed from sets and counts; the weights' gradient is zero."""
    import numpy as np
    import pyarrow as pa

    texts = [("Älpha beta gammä " + ("schlimm schlimm " if k % 3 == 0 else "good ") + f"n{k % 7}") for k in range(60)]
    y = np.array([k % 3 == 0 for k in range(60)])

    def brute(text):
        low = text.lower()
        c = Counter(low[i : i + n] for n in toxicity.SIZES for i in range(len(low) - n + 1))
        return {(g, level) for g, n in c.items() for level in toxicity.LEVELS if n >= level}

    sets = list(map(brute, texts))
    row, col = toxicity.distinct_features(pa.array(texts))
    assert [int((row == k).sum()) for k in range(60)] == list(map(len, sets))
    assert len(np.unique(col)) == len(set().union(*sets))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.learn(spark, docs, spark.createDataFrame([(k, int(t)) for k, t in enumerate(y)], "doc_id long, toxic int"))
    # Ratios by counting documents.
    names = {}
    for k, s in enumerate(sets):
        own = {int(c) for c in col[row == k]}
        for f in own:
            names.setdefault(f, set()).add(k)
    p = {f: sum(y[k] for k in ks) for f, ks in names.items()}
    q = {f: len(ks) - p[f] for f, ks in names.items()}
    used = model["slots"].tolist()
    a, b = sum(p[f] + 1 for f in used), sum(q[f] + 1 for f in used)
    ratio = np.array([math.log((p[f] + 1) / a) - math.log((q[f] + 1) / b) for f in used])
    x = np.array([[k in names[f] for f in used] for k in range(60)], float) * ratio
    w = np.array(model["weights"]) / ratio
    z = x @ w + model["bias"]
    err = 1 / (1 + np.exp(-z)) - y
    assert np.abs(x.T @ err + toxicity.L2 * w).max() < 1e-2 and abs(err.sum()) < 1e-2
    got = {r.doc_id: r.score for r in toxicity.score(spark, docs, model).collect()}
    assert [got[k] for k in range(60)] == pytest.approx((1 / (1 + np.exp(-z))).tolist())


def test_language_counts_against_sets(spark):
    """Filters hold what sets of n-grams say; scores are shares of counts less the filters' false positives."""
    rows = [(k, t, x) for k, (t, x) in enumerate([("the cat and the dog and the cow", "en"), ("der hund und der fuchs und der", "de")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = language.learn(spark, docs)
    grams = lambda t: [t.encode()[i : i + 4] for i in range(len(t.encode()) - 3)]
    count = {x: Counter(g for _, t, y in rows if y == x for g in grams(t)) for x in langs}
    total = {x: sum(c.values()) for x, c in count.items()}
    best = {g: max(count[x][g] / total[x] for x in langs) for x in langs for g in count[x]}
    own = {x: {g for g in count[x] if count[x][g] >= language.MIN_COUNT and count[x][g] / total[x] >= language.MIN_RATE * best[g]} for x in langs}
    got = {r.doc_id: r for r in language.identify(spark, docs, langs, table).collect()}
    for d, t, x in rows:
        hits = {y: sum(g in own[y] for g in grams(t)) for y in langs}
        assert got[d].lang_pred == max(langs, key=lambda y: hits[y]) == x
        assert got[d].score == pytest.approx(hits[x] / sum(hits.values()), abs=1e-3)
        assert got[d].coverage == pytest.approx(hits[x] / len(grams(t)), abs=1e-3)


def test_many_languages(spark):
    """More languages than a word has bits."""
    rows = [(k, " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}{w}" for w in ("alpha", "omega", "delta") * 4), f"l{k:03d}") for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = language.learn(spark, docs)
    assert len(langs) == 70 and table.shape[0] == 2
    got = {r.doc_id: r.lang_pred for r in language.identify(spark, docs, langs, table).collect()}
    assert got == {d: x for d, _, x in rows}


# 7 ------------------------------------------------------------------------------------------------------------------


def brute_dedup(rows, width=35):
    ws = [(d, words(t)) for d, t in rows]
    count = Counter(tuple(w[i : i + width]) for _, w in ws for i in range(len(w) - width + 1))
    out = []
    for d, w in ws:
        stay = [True] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                stay[i : i + width] = [False] * width
        left = b" ".join(x for x, s in zip(w, stay, strict=True) if s)
        out.append((d, len(w), len(w) - sum(stay), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [500, 1])
def test_substring_dedup(spark, odd, none, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    shared = " ".join(f"s{k}" for k in range(80))
    own = lambda k, n: " ".join(f"o{k}x{j}" for j in range(n))
    rows = [(100 + k, f"{own(k, k)} {shared} {own(k + 50, 9)}") for k in range(6)] + [(200, own(1, 34)), (201, own(1, 35)), (202, own(1, 35) + " tail"), (203, "a b c " * 20)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("start", F.lit(None))
    want = brute_dedup([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(map(tuple, substring_dedup.dedup_digest(spark, df).collect())) == want
    assert substring_dedup.dedup_digest(spark, none).count() == 0


def test_fm_index():
    import numpy as np

    r = np.random.RandomState(5)
    seqs = [r.randint(1, 4, r.randint(35, 60)) for _ in range(60)] + [np.tile([1, 2, 3], 15)]
    seqs += [np.concatenate((seqs[0][:40], [3, 1])) if len(seqs[0]) >= 40 else seqs[0]]
    starts, parts, at = [], [], 0
    for s in seqs:
        starts.append(at)
        parts += [s, [0]]
        at += len(s) + 1
    text = np.concatenate(parts).astype(np.int32)
    for width in (4, 8, 35):
        n = np.array([len(s) - width + 1 for s in seqs])
        seq, win = fm_index.repeated_windows(text, np.array(starts), n, width)
        c = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
        assert list(zip(seq.tolist(), win.tolist(), strict=True)) == [(p, i) for p, s in enumerate(seqs) for i in range(len(s) - width + 1) if c[tuple(s[i : i + width])] > 1]
        # Sequences that stand for several are repeated by themselves.
        weights = np.array([1 + (p % 5 == 0) for p in range(len(seqs))])
        c = Counter()
        for s, w in zip(seqs, weights.tolist(), strict=True):
            for i in range(len(s) - width + 1):
                c[tuple(s[i : i + width])] += w
        seq, win = fm_index.repeated_windows(text, np.array(starts), n, width, weights)
        assert list(zip(seq.tolist(), win.tolist(), strict=True)) == [(p, i) for p, s in enumerate(seqs) for i in range(len(s) - width + 1) if c[tuple(s[i : i + width])] > 1]


def test_dedup_of_rows_without_ids(spark):
    """Rows with a null doc_id, and several texts of one doc_id, lose their own windows."""
    text = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(None, text("a", 50) + " tail one"), (None, text("c", 40)), (None, None), (1, "head " + text("a", 50)), (1, text("b", 60)), (2, text("b", 40))]
    got = substring_dedup.dedup_digest(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in got), key=str) == sorted([(None, 52, 50), (None, 40, 0), (None, 0, 0), (1, 51, 50), (1, 60, 40), (2, 40, 40)], key=str)


# 8 ------------------------------------------------------------------------------------------------------------------


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t in rows:
        w = words((t or "").translate(lower))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()))
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, p) in enumerate(sets):
        for b, q in sets[:i]:
            if p and q and 100 * len(p & q) >= 75 * len(p | q):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets)


def test_ngram_join(spark, odd, none):
    base = [f"t{k}" for k in range(120)]
    near = [(300 + k, " ".join(base[: 120 - 3 * k] + [f"n{k}x{j}" for j in range(k)])) for k in range(15)]
    exact = [(400, "Just Four words here"), (401, "just four WORDS here"), (402, "just four words"), (403, "a b c d e f g h"), (404, "a b c d e f g x")]
    # 75 of 100 shingles: at the threshold, and one below it.
    edge = [(500, " ".join(f"e{k}" for k in range(104))), (501, " ".join(f"e{k}" for k in range(79))), (502, " ".join(f"e{k}" for k in range(78)))]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(near + exact + edge, "doc_id long, text string")).withColumn("gram", F.lit("clash"))
    want = brute_components([(r.doc_id, r.text) for r in df.collect()])
    got = sorted(map(tuple, ngram_join.join_components(spark, df).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == want
    assert dict((d, c) for d, _, c in got)[501] == 500 and dict((d, c) for d, _, c in got)[401] == 400
    assert ngram_join.join_components(spark, none).count() == 0


def test_templates_do_not_meet(spark):
    """Documents that share a template, but too little of it, make few pairs; those with enough of it are linked."""
    from lodestone.llm import ngram_join as j

    base = [f"t{k}" for k in range(150)]
    low = [(k, " ".join(base[:130] + [f"a{k}x{i}" for i in range(40)])) for k in range(300)]
    high = [(1000 + k, " ".join([f"h{i}" for i in range(150)] + [f"b{k}x{i}" for i in range(12)])) for k in range(20)]
    df = spark.createDataFrame(low + high, "doc_id long, text string")
    assert sorted(map(tuple, j.join_components(spark, df).collect())) == brute_components(low + high)
    scratch = Scratch(spark, "templates")
    rows = df.select("doc_id", "text")
    members, shared, _ = j._shared_grams(spark, rows, spark.sparkContext.broadcast(j.hot_grams(rows)), scratch)
    none = spark.createDataFrame([], "node long, component long")
    assert j._all_pairs(shared, none).where("x < 1000").count() <= 300


def test_bitmaps():
    """Folded bitmaps differ where an odd number of n-grams of one set or the other falls, whatever the two lengths."""
    import numpy as np

    sets = [np.unique(np.random.RandomState(k).randint(0, 1 << 62, size)).astype(np.uint64) for k, size in enumerate((0, 1, 30, 40, 5_000, 5_100, 100_000))]
    sets += [np.sort(np.concatenate((sets[4][:-200], sets[5][:100])))]
    n = np.array(list(map(len, sets)))
    bits = ngram_join.bitmaps(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), n).to_pylist()
    assert [8 * len(b) for b in bits] == [64, 64, 64, 128, 16384, 16384, 131072, 16384]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1)]
    got = ngram_join.apart([bits[i] for i, _ in pairs], [bits[j] for _, j in pairs])
    for (i, j), value in zip(pairs, got.tolist(), strict=True):
        width = np.uint64(8 * min(len(bits[i]), len(bits[j])))
        differ = np.setxor1d(sets[i], sets[j])
        assert value == (np.unique(differ % width, return_counts=True)[1] % 2).sum() <= len(differ)


def test_ngram_join_of_repeated_ids(spark):
    """A doc_id with two texts keeps both rows; it is linked by the smallest of its texts, and by equal ones of either."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(1, text("a")), (2, text("b")), (2, text("a")), (3, text("b")), (4, text("a") + " more"), (5, None), (5, text("c"))]
    got = ngram_join.join_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 56, 1), (2, 56, 1), (2, 56, 1), (3, 56, 1), (4, 57, 1), (5, 0, 5), (5, 56, 5)]


def test_components_of_long_chains(spark):
    from lodestone.llm.common import Scratch
    from lodestone.llm.components import components

    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 105), (105, 101)], "x long, y long")
    groups = defaultdict(set)
    for r in components(Scratch(spark, "t"), links, "c").collect():
        groups[r.component].add(r.node)
    assert {k: len(v) for k, v in groups.items()} == {0: 31, 100: 3}


@pytest.mark.parametrize("part", ['See <a href="/hidden-gems">the famous list</a> of them', '<p title="a hidden valley">the famous list</p>', '<p data-class="ad">the famous list</p>', '<p data-role="banner" data-style="display:none">the famous list</p>', "<p data-x='class=\"ad\"'>the famous list</p>", "<p/data-id=nav title=hidden>the famous list</p>", '<header><h1>the famous list</h1></header>', '<h2 class="header">the famous list</h2>'])
def test_attributes_are_whole_names(part):
    assert "the famous list" in site_style.main_text(f"<body><article><p>First one of the story.</p>{part}<p>Last one.</p></article></body>")


@pytest.mark.parametrize("part", ['<p class="ad">gone</p>', "<p CLASS=ad>gone</p>", "<div a=1 id='nav'>gone</div>", "<p hidden>gone</p>", '<p a="b"hidden>gone</p>', '<p style="color:red;display: none">gone</p>', "<p aria-hidden=TRUE>gone</p>"])
def test_attributes_still_hide(part):
    assert site_style.main_text(f"<body><article><p>First one of the story.</p>{part}<p>Last one.</p></article></body>") == "First one of the story.\n\nLast one."


def test_deep_nesting(spark):
    import time

    for tags in (["<div>"] * 20_000, ['<div class="notice">'] * 20_000, ["<b>"] * 20_000):
        began = time.time()
        assert site_style.main_text("".join(tags) + "end" + "</div>" * 5) == "end"
        key, rows = site_style.tree_rows("".join(tags) + "end")
        assert time.time() - began < 2 and len(rows) < 200_000
    deep = "<div>" * 700
    df = spark.createDataFrame([(k, f"http://deep/{k}", f"{deep}<p>{'same' if k < 9 else k}</p><p>own {k}</p>") for k in range(12)], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in site_style.extract(spark, df).collect()}
    assert all(f"own {k}" in texts[k] for k in range(12))


def test_many_rows_without_an_id_keep_their_own_words(spark):
    """70,000 documents without an id: with keys of 31 bits some would take each other's spans."""
    from pyspark.sql import functions as F

    passage = " ".join(f"p{k}" for k in range(35))
    rows = spark.range(70_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("own"), F.col("id").cast("string")), F.when(F.col("id") % 1000 == 0, F.lit(passage)).otherwise(F.lit("short text"))).alias("text"))
    got = substring_dedup.dedup_digest(spark, rows).groupBy("n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(3, 0, 69_930), (36, 35, 70)]


def test_equal_rows_are_one_document_of_their_host(spark):
    line = "the same line of words everywhere on this host"
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    body = lambda k: " ".join(f"w{letters(k)}x{letters(j)}" for j in range(80))
    rows = [(k, f"{body(k)}\n{line}" if k < 25 else body(k), "h") for k in range(100)]
    schema = "doc_id long, text string, source string"
    frequent = lambda r: line_rules.frequent_lines(spark.createDataFrame(r, schema)).count()
    assert frequent(rows) == 1
    assert frequent(rows + [rows[-1]] * 5000) == 1


def test_a_repeated_document_is_learned_from_once(spark):
    rows = [(1, "bad words here"), (1, "bad words here"), (2, "good day"), (None, "good day")] * 50
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_query(spark, docs, labels)
    assert got.count() == 200 and got.where("held_out is null or score is null").count() == 0
