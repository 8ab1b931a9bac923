"""Corpus operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tablekin.llm import decontaminate, html_extract, license_scan, line_dedup, lm_score, near_dup, quality_rules, sentencepiece_bpe, substring_dedup, suffix_dedup
from tablekin.llm.common import cover, spans_of
from tablekin.llm.fm_index import FmIndex, suffix_order
from tablekin.llm.repeats import HEAD, sliding_min

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus():
    """Texts of a small vocabulary, with copies, near copies, shared passages and the odd cases."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdeéß", k=draw.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage, line = text(120), text(60), "A common line, met often."
    out = [text(draw.randint(1, 150)) for _ in range(30)]
    out += [base] * 4 + [base.replace(" ", "  ", 1)]
    for k in range(6):
        words = base.split()
        words[7 * k + 3] = "changed"
        out.append(" ".join(words))
    out += [text(40) + " " + passage + " " + text(30) + "\n" + line for _ in range(12)]
    out += ["", " \n\t", "one", "two words", "One", "x " * 300, passage + " " + passage, "\n\n\n", "  ", "MIXED Case WORDS " * 30, text(5000)]
    rows = [(k, t, "en", "src0" if k % 3 else None, len(t)) for k, t in enumerate(out)]
    rows += [(200, None, None, None, None), (None, base, "en", "s", 1), rows[3], (201, passage, "en", "s", 1)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")).withColumn("bucket", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_decontaminate(spark, docs, rows, empty):
    items = [(k, " ".join((t or "").split()[3:25])) for k, t, *_ in rows[:8]] + [(50, "One"), (51, None), (52, "..."), (None, "two words"), (50, "One")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        w = decontaminate.words_of((text or "").encode())
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(item)
    want = []
    for doc, text, *_ in rows:
        w = decontaminate.words_of((text or "").encode())
        hit, named = np.zeros(len(w), bool), set()
        for p, own in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit[k : k + len(p)] = True
                    named |= own
        want.append((doc, len(w), [(int(a), int(b)) for a, b in spans_of(hit)], sorted(named - {None})))
    for block_bytes in (1 << 20, 300):
        found = decontaminate.find_contamination(docs.select("doc_id", "text"), bench, block_bytes=block_bytes)
        got = [(r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], sorted(r["items"])) for r in found.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = decontaminate.remove_passages(docs, bench)
    assert kept.columns == docs.columns
    clean = {w[0] for w in want if not w[2]}
    assert clean <= {r["doc_id"] for r in kept.collect()}
    assert decontaminate.find_contamination(empty.select("doc_id", "text"), bench).count() == 0
    assert decontaminate.find_contamination(docs.select("doc_id", "text"), bench.limit(0)).filter("size(spans) > 0").count() == 0


def test_cut_spans():
    assert decontaminate.cut_spans("Ab, cd\nef gh!", [(1, 3)]) == "Ab,  gh!"


def test_fm_index():
    draw = np.random.default_rng(0)
    for _ in range(20):
        s = draw.integers(1, 4, draw.integers(1, 200)).astype(np.int32)
        s[draw.random(len(s)) < 0.1] = 0
        s[-1] = 0
        stop = [int(np.flatnonzero(s[k:] == 0)[0]) + k for k in range(len(s))]
        order = suffix_order(s, 4)
        assert order.tolist() == sorted(range(len(s)), key=lambda k: (tuple(s[k : stop[k]]) + (0,), k))
        index = FmIndex(s, 4)
        assert (index.locate(np.arange(len(s))) == order).all()
        pattern = draw.integers(1, 4, (4, 2))
        for p, a, b in zip(pattern, *index.search(pattern), strict=True):
            assert sorted(index.locate(np.arange(a, b))) == [k for k in range(len(s) - 1) if (s[k : k + 2] == p).all()]


def test_line_dedup(docs, rows, empty):
    keys = lambda t: [x.strip("\t\n\x0b\x0c\r ").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    found = {}
    for doc, text, *_ in rows:
        for k in keys(text):
            found.setdefault(k, set()).add(doc)
    want = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, keys(text), strict=True) if not (k and len(found[k]) >= 10)]
        want.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert any(w[2] for w in want)
    assert result(line_dedup.drop_frequent_lines(docs)) == sorted(want, key=repr)
    assert line_dedup.drop_frequent_lines(empty).count() == 0


def test_near_duplicates(docs, rows, empty):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    want = sorted(((r[0], len(s), least[g] if s else r[0]) for r, s, g in zip(rows, sets, group, strict=True)), key=repr)
    assert result(near_dup.near_duplicate_groups(docs)) == want
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted({repr(w[0]) for w in want if w[0] == w[2]})
    assert near_dup.near_duplicate_groups(empty).count() == 0


def test_keep_first_drops_linked_texts_only(spark):
    text = lambda tag, n=60: " ".join(f"{tag}{k}" for k in range(n))
    near = text("a", 59)
    rows = [(None, text(f"n{k}x"), k) for k in range(8)]  # clean texts without ids
    rows += [(None, text("n0x"), 20), (None, None, 21), (None, " \n", 22), (None, "", 23)]
    rows += [(5, text("a"), 30), (5, text("b"), 31), (6, near, 32)]  # two texts under one id
    rows += [(3, text("c"), 40), (9, text("c", 59), 41), (9, text("d"), 42)]  # a near copy under the id of another text
    rows += [(10, text("c", 58), 43), (13, text("c", 57), 44)]
    rows += [(11, text("e"), 51), (11, text("e"), 50), (12, "", 52), (12, "", 53)]
    want = sorted([*range(8), 21, 22, 23, 30, 31, 40, 42, 50, 52, 53])
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, key long").repartition(parts)
        kept = near_dup.keep_first(docs)
        assert kept.columns == docs.columns
        assert sorted(r["key"] for r in kept.collect()) == want


def test_near_copies_are_sent_few_times(spark, monkeypatch):
    """Groups of near copies, with blocks far smaller than a group: the same links, and not a row per set and block."""
    draw = random.Random(8)
    rows, groups, size = [], 4, 60
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(100)]
        for m in range(size):
            words = list(base)
            words[draw.randrange(100)] = f"new{m}"
            rows.append((1000 * g + m, " ".join(words)))
    rows += [(9000 + k, f"alone {k} " + " ".join(str(draw.random()) for _ in range(30))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_dup, "BLOCK", 250)
    want = sorted((d, d - d % 1000 if d < 9000 else d) for d, _ in rows)
    found = near_dup.near_duplicate_groups(docs).select("doc_id", "component_id")
    assert sorted(map(tuple, found.collect())) == want

    def unread(percent):
        def run(batches):
            for batch in batches:
                yield batch.select(["cls", "cls"]).rename_columns(["u", "v"])

        return run

    sent, keep = [], near_dup.materialize
    monkeypatch.setattr(near_dup, "_scan", unread)
    monkeypatch.setattr(near_dup, "materialize", lambda df, label: (sent.append(df.count()) if label == "links" else None, keep(df, label))[1])
    near_dup.near_duplicate_groups(docs)
    assert groups * size <= sent[0] <= 4 * groups * size


@pytest.mark.parametrize("most", [1 << 19, 3000])
def test_every_fitting_pair_meets(monkeypatch, most):
    """Of two entries of one list that fit, one is sent to the block where the other stays, however lists are cut into runs."""
    monkeypatch.setattr(near_dup, "RUN", most)
    draw, fit, blocks = np.random.default_rng(4), near_dup.Fit(75), 50
    n = 3000
    owner = draw.integers(0, 1 << 64, n, np.uint64)
    size = draw.integers(70, 110, n).astype(np.uint8)
    lists = [draw.choice(n, k, replace=False) for k in (1, 2, 2, 3, 5, 9, 16, 17, 40, 300)] + [draw.choice(n, 4) for _ in range(300)]
    entries = np.zeros(sum(map(len, lists)), near_dup.ENTRY)
    entries["sig"] = np.repeat(np.arange(len(lists), dtype=np.uint64), [len(x) for x in lists]).view(np.uint8).reshape(-1, 8)[:, :5]
    at = np.concatenate(lists)
    entries["owner"], entries["size"], entries["far"] = owner[at], size[at], draw.integers(0, 60, len(at))
    packed = near_dup._lists([(0, 0, None, entries.tobytes())])
    headed = list(near_dup._head(75, 7)(iter([packed])))
    placed = list(near_dup._place(blocks)(iter(headed)))
    routes = near_dup.unpack_rows(near_dup._meet(75, 5)(iter(placed)), near_dup.ROUTE)
    to, home = {}, {}
    for short, block in zip(routes["short"].tolist(), routes["block"].tolist(), strict=True):
        if block >= 0:
            to.setdefault(short, set()).add(block)
        else:
            assert home.setdefault(short, near_dup.STAYS_IN - block) == near_dup.STAYS_IN - block
    pairs = 0
    for k in range(len(lists)):
        own = entries[(entries["sig"] == entries["sig"][sum(map(len, lists[:k]))]).all(1)]
        for i in range(len(own)):
            for j in np.flatnonzero(fit(own["size"][i], own["far"][i], own["size"][i + 1 :], own["far"][i + 1 :])) + i + 1:
                a, b = int(own["owner"][i]), int(own["owner"][j])
                pairs += a != b
                assert a == b or home.get(b, -1) in to.get(a, ()) or home.get(a, -1) in to.get(b, ())
    assert pairs > 1000


def test_light_sets_find_all_links():
    draw = random.Random(3)
    limit = near_dup.Threshold(75)
    none = np.zeros(0, np.int64)
    for _ in range(300):
        a = set(draw.sample(range(1, 40), draw.randint(1, 14)))
        b = (a - set(draw.sample(sorted(a), draw.randint(0, min(3, len(a) - 1))))) | set(draw.sample(range(40, 60), draw.randint(0, 3)))
        own = [near_dup._signatures(np.array(sorted(x), np.uint64), limit, 9, none, none)[0] for x in (a, b)]
        if limit.linked(len(a & b), len(a), len(b)):
            assert set(own[0].tolist()) & set(own[1].tolist())


def test_substring_dedup(docs, rows, empty):
    texts = {(r[0], r[1]): (r[1] or "").encode().split() for r in rows}
    order = sorted(texts, key=lambda k: (k[0] is not None, k[0] or 0))
    seen, want = set(), {}
    for key in order:
        w, gone = texts[key], np.zeros(len(texts[key]), bool)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[k : k + 20] = True
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[key] = (key[0], len(w), int(gone.sum()), kept.decode(), sha(kept))
    assert any(w[2] for w in want.values())
    assert result(substring_dedup.remove_repeats(docs)) == sorted((want[r[0], r[1]] for r in rows), key=repr)
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize(("size", "gram"), [(400, 160), (40, 16)])
def test_suffix_dedup(docs, rows, empty, size, gram):
    texts = {(r[0], r[1]): (r[1] or "").encode() for r in rows}
    count = Counter(t[k : k + size] for t in texts.values() for k in range(len(t) - size + 1))
    want = []
    for r in rows:
        t = texts[r[0], r[1]]
        starts = np.array([k for k in range(len(t) - size + 1) if count[t[k : k + size]] > 1], np.int64)
        gone = cover(len(t), starts, size)
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((r[0], len(t), int(gone.sum()), len(spans_of(gone)), sha(left)))
    assert any(w[2] for w in want)
    got = suffix_dedup.remove_repeated_bytes(docs, size, gram).drop("text")
    assert result(got) == sorted(want, key=repr)
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


def test_two_stage_order():
    draw = np.random.default_rng(1)
    for _ in range(100):
        parts = [x for _ in range(draw.integers(1, 6)) for x in (draw.integers(1, draw.integers(2, 5), draw.integers(1, 30)), [0])]
        s = np.concatenate(parts).astype(np.int32)
        stop = [int(np.flatnonzero(s[k:] == 0)[0]) + k for k in range(len(s))]
        want = sorted(range(len(s)), key=lambda k: tuple(s[k : stop[k]]) + (stop[k] - len(s),))
        assert suffix_dedup.two_stage_order(s, 64).tolist() == want


def test_suffix_solver():
    draw = np.random.default_rng(2)
    for _ in range(50):
        strings = [bytes(draw.integers(97, 99, draw.integers(9, 40)).astype(np.uint8)) for _ in range(draw.integers(1, 6))]
        heads = np.zeros(len(strings), HEAD)
        count = Counter(s[k : k + 9] for s in strings for k in range(len(s) - 8))
        got = {k: v.tolist() for k, v in suffix_dedup.mark_repeated(9)(heads, strings)}
        for k, s in enumerate(strings):
            starts = np.array([j for j in range(len(s) - 8) if count[s[j : j + 9]] > 1], np.int64)
            assert got.get(k, []) == spans_of(cover(len(s), starts, 9)).tolist()


def test_sliding_min():
    key = np.random.default_rng(0).integers(0, 99, 57)
    assert sliding_min(key, 7).tolist() == [key[k : k + 7].min() for k in range(51)]


def test_sentencepiece(docs, rows, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "")
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), ids))
    assert result(sentencepiece_bpe.encode_documents(docs, path, with_ids=True)) == sorted(want, key=repr)
    assert sentencepiece_bpe.encode_documents(empty, path).count() == 0


def test_sentencepiece_odd_texts():
    v = sentencepiece_bpe.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    draw = random.Random(1)
    odd = ["  a  b ", "▁x y", "▁ ", "日本\x00a", "a<s>b", "<0x41>", "�", "\r\n x", "\n \n", "ab" * 300, " " * 70, "😀 é́", "e.g., (x)!!", " x"]
    odd += ["".join(draw.choices("ab .,\n▁é!*日", k=60)) for _ in range(200)]
    for text in odd:
        ids = v.encode(text)
        assert ids == v.library.encode(text)
        assert v.decode(ids) == v.library.decode(ids)
        v.learn(set(v.prepared(text)))
        assert ",".join(v.known[u] for u in v.prepared(text)) == ",".join(map(str, ids))


def test_quality(docs, rows, empty):
    scored = {(r["doc_id"], r["n_words"]): r for r in quality_rules.score_documents(docs).collect()}
    for doc, text, *_ in rows:
        t = text or ""
        w = t.encode().split()
        count = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = np.zeros(len(w), bool)
        for k in range(len(w) - 2):
            if count[w[k], w[k + 1], w[k + 2]] > 1:
                hit[k : k + 3] = True
        lines = [x for x in t.split("\n") if x.strip("\t\n\x0b\x0c\r ")]
        r = scored[doc, len(w)]
        assert r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), hit.sum())
        assert r["base_failed"] == (len(w) < 50 or 100 * hit.sum() > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.score_documents(empty).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_quality_learns_from_votes():
    draw = np.random.default_rng(0)
    good = draw.random(4000) < 0.8
    rules = len(quality_rules.RULES)
    bad_vote = np.where(good[:, None], draw.random((4000, rules)) < 0.01, draw.random((4000, rules)) < 0.4)
    codes = ((np.where(bad_vote, -1, 1) + 1) * 3 ** np.arange(rules - 1, -1, -1)).sum(1)
    kinds, weights = np.unique(codes, return_counts=True)
    chance, share = quality_rules.fit_accuracies(kinds, weights)
    said = quality_rules.posterior(quality_rules.votes_of(codes), chance, share) >= 0.5
    assert (said == good).mean() > 0.95
    assert said[good].mean() > 0.9


PARAGRAPHS = [
    "This is the first paragraph of the article, with a few sentences. It goes on for a while, as articles do, and then ends here.",
    "Second paragraph: the story continues, with more detail about the matter. Nobody knew, of course, what would come next.",
]
LAYOUTS = {
    "article": "<nav><a href=1>Home</a></nav><article><h1>Title</h1><p>{0}<p>{1}</article><footer>Made by us</footer>",
    "div": '<header><h1>Site</h1><p>All the news.</p></header><ul class="menu"><li><a href=1>Home</a></li></ul><div id="content"><h1>Title</h1><p>{0}</p>'
    '<p>{1}</p></div><div class="sidebar"><p>Some other story you may like, read it now.</p></div><div class="comments"><p>Great, I liked it. Thanks.</p></div>',
    "plain": '<div><div class=top><a href=a>Home</a> <a href=b>News</a></div><div><h2>Title</h2><p>{0}<p>{1}</div><div class="cookie-notice">We use cookies, please '
    "accept.</div><form><label>Email</label><input><button>Subscribe</button></form></div>",
    "main": '<main><article class="post"><header><h1>Title</h1></header><p>{0}</p><div class="advert">Buy now! Great offers, today only.</div><p>{1}</p>'
    '<section id="comments"><article><p>Nice text, thank you very much.</p></article></section></article><aside><p>Aside, with commas, and such.</p></aside></main>',
}


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body>{}</body></html>"
    labelled = [page.format(LAYOUTS["article"].format(a, b)) for a in PARAGRAPHS for b in PARAGRAPHS]
    named = [(k, "u", page.format(v.format(*PARAGRAPHS))) for k, v in enumerate(LAYOUTS.values())]
    odd = [(90, None, None), (91, "u", ""), (92, "u", "<"), (93, "u", "<!-- x"), (94, "u", "<script>"), (95, "u", "<div>" * 3000 + "x &amp;&nbsp; y"), (90, None, None)]
    pages = spark.createDataFrame(named + odd + [(k + 100, "u", h) for k, h in enumerate(labelled)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract_text(pages.withColumn("text", F.lit(1))).collect()}
    for k in range(len(LAYOUTS)):
        assert got[k]["text"] == "\n\n".join(["Title", *PARAGRAPHS])
    assert [got[k]["text"] for k in (90, 91, 93, 94)] == [""] * 4
    assert got[95]["text"] == "x & y"
    assert got[95]["n_chars"] == 5
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_html_messages_give_exact_marginals():
    page = html_extract.Page("<div><p>one two, three.</p><div><a href=1>x</a><p>y</p></div></div><p>z. z. z.</p>")
    model = html_extract.train([])
    score, holds, n = page.features() @ model.weights, page.holds(), len(page.tag)
    total = np.zeros(n)
    for bits in range(2**n):
        y = [(bits >> k) & 1 for k in range(n)]
        weight = np.exp(sum(s for s, v in zip(score, y, strict=True) if v) + sum(model.passing[holds[k], y[page.parent[k]], y[k]] for k in range(1, n)))
        total += weight * np.array(y)
        total[0] += 0
        if bits == 0:
            whole = 0.0
        whole += weight
    assert np.allclose(model.marginals(page), total / whole)


def test_licenses(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code here and there"), (3, "a/b/y.py", "text\nLicensed under the Apache License, Version 2.0.\n" + "word " * 40),
        (4, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), (5, "a/b/c/d/z", None), (6, "q/z", "nothing"), (7, None, "nothing"),
        (8, "a/b/x.py", "code here and there"), (9, "top", ""),
    ]
    got = {r["doc_id"]: (r["license"], r["origin"], r["inherited_from"]) for r in license_scan.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "file", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "header", None), 4: ("GPL-3.0", "file", None), 5: ("GPL-3.0", "inherited", "a/b/c"),
        6: (None, None, None), 7: (None, None, None), 8: ("MIT", "inherited", "a"), 9: (None, None, None),
    }
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_lm_prefers_learned_order(spark, empty):
    draw = random.Random(4)
    order = lambda: " ".join(f"{a} {b} {c}" for a, b, c in [("the", draw.choice(["cat", "dog", "cow"]), draw.choice(["runs", "sits"])) for _ in range(60)])
    texts = [order() for _ in range(300)]
    mixed = texts[0].split()
    draw.shuffle(mixed)
    rows = [*enumerate(texts), (900, " ".join(mixed)), (901, None), (902, ""), (903, "unknown"), (0, texts[0])]
    got = {r["doc_id"]: r for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), words=50, classes=20).collect()}
    assert got[0]["mean_log_prob"] > got[900]["mean_log_prob"] + 0.5
    assert (got[901]["n_words"], got[901]["log_prob"], got[901]["mean_log_prob"]) == (0, 0.0, None)
    assert got[903]["n_words"] == 1
    assert lm_score.score_documents(empty).count() == 0


def test_lm_trains_on_every_word(spark, monkeypatch):
    texts = [" ".join(f"w{k % 7}" for k in range(a, a + 30)) for a in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    known = lm_score.vocabulary(docs, 50, 20)
    seen = []
    monkeypatch.setattr(lm_score.Network, "learn", lambda net, near, target, memory: seen.append((near.tolist(), target.tolist())))
    batch = lm_score.encode(docs, known, 1 << 21).filter("kind = 1").select("part", "ids", "sizes", "payload").toArrow().to_batches()
    list(lm_score._train(known.classes, lm_score.Network(known.classes, 32).vector(), 32)(iter(batch)))
    lines = [[int(c) for c in known.class_of[known.read(t.encode().split())]] for t in texts]
    words = [(x[k - 2] if k > 1 else known.classes, x[k - 1] if k else known.classes, x[k], (*x, known.classes)[k + 1], (*x, *[known.classes] * 2)[k + 2]) for x in lines for k in range(30)]
    got = [(n[0][k], n[1][k], t[k], n[2][k], n[3][k]) for n, t in seen for k in range(len(t))]
    assert sorted(got) == sorted(words)


LM_WORDS = ["the", "cat", "dog", "sits", "runs", "é", "under", "trees", "ßx", "longer-than-sixteen-letters"] + [f"r{k}" for k in range(40)]


def lm_rows():
    draw = random.Random(8)
    rows = [(k, " ".join(draw.choices(LM_WORDS, weights=[30] * 5 + [3] * 5 + [1] * 40, k=draw.randint(1, 60)))) for k in range(120)]
    return rows + [(200, None), (201, ""), (None, "the cat"), (None, "the dog"), (7, "the cat"), (202, "THE  Cat\n"), (203, "the " * 5000)]


def test_lm_scores_equal_a_plain_computation(spark):
    """Counts, shares, contexts and softmax worked out word by word, under the trained weights."""
    rows = lm_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kind string, part int").repartition(5)
    known = lm_score.vocabulary(docs.select("doc_id", "text"), 6, 4)
    coded = lm_score.encode(docs.select("doc_id", "text"), known, 500)
    weights = lm_score.train(coded, known.classes)
    net = lm_score.Network(known.classes, 32).load(weights)
    texts = [(t or "").encode().lower().split() for _, t in rows]
    count = Counter(w for t in texts for w in t)
    top = sorted(count, key=lambda w: (-count[w], w))[:6]
    assert sorted(known.number, key=known.number.get) == top and known.total == sum(count.values())
    group = {w: int(known.class_of[known.number[w]]) if w in top else known.classes - 17 + min(len(w), 16) for w in count}
    mass = Counter()
    for w, n in count.items():
        mass[group[w]] += n
    want = []
    for (doc_id, _), text in zip(rows, texts, strict=True):
        total = 0.0
        for k, w in enumerate(text):
            near = [group[text[k + s]] if 0 <= k + s < len(text) else known.classes for s in (-2, -1, 1, 2)]
            score = np.tanh(sum(net.tables[i, c].astype(float) for i, c in enumerate(near))) @ net.out[:-1].astype(float) + net.out[-1]
            total += score[group[w]] - np.log(np.exp(score).sum()) + np.log(count[w] / mass[group[w]])
        want.append((str(doc_id), len(text), total))
    got = sorted((str(r["doc_id"]), r["n_words"], r["log_prob"]) for r in lm_score.score_coded(coded, known, weights).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5, abs=1e-5)


def test_lm_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(lm_rows(), "doc_id long, text string")
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["log_prob"])
    of = lambda n: sorted(key(r) for r in lm_score.score_documents(docs.repartition(n), words=6, classes=4, shard_words=500).collect())
    one = of(1)
    for n in (4, 16):
        assert [a[:2] for a in of(n)] == [a[:2] for a in one]
        assert [a[2] for a in of(n)] == pytest.approx([a[2] for a in one], rel=1e-6)


def test_lm_step_uses_its_rooms_again(monkeypatch):
    """A step makes no arrays of the batch's size anew, and scores that need no shift give what shifted ones give."""
    draw = np.random.default_rng(6)
    near, target = draw.integers(0, 114, (4, 2048)).astype(np.uint8), draw.integers(0, 113, 2048).astype(np.uint8)
    found = []
    for safe in (lm_score.SAFE, -1.0):
        monkeypatch.setattr(lm_score, "SAFE", safe)
        net = lm_score.Network(113, 32)
        memory = [np.zeros_like(net.out), np.zeros_like(net.tables)]
        assert net.small() == (safe > 0)
        net.learn(near, target, memory)
        tracemalloc.start()
        net.learn(near, target, memory)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 500_000
        found.append((net.vector(), net.log_chance(near, target)))
    assert np.allclose(found[0][0], found[1][0], atol=1e-5) and np.allclose(found[0][1], found[1][1], atol=1e-5)


def test_lm_step_is_adagrad():
    draw = np.random.default_rng(2)
    near, target = draw.integers(0, 6, (4, 40)), draw.integers(0, 5, 40)
    net = lm_score.Network(5, 3)
    out, tables = net.out.astype(float), net.tables.astype(float)
    h = np.tanh(sum(tables[k][near[k]] for k in range(4)))
    chance = np.exp(h @ out[:-1] + out[-1])
    error = (chance / chance.sum(1, keepdims=True) - np.eye(5)[target]) / 40
    back = (error @ out[:-1].T) * (1 - h * h)
    gradients = [np.vstack([h.T @ error, error.sum(0)]), np.stack([np.eye(6)[near[k]].T @ back for k in range(4)])]
    net.learn(near, target, [np.zeros_like(net.out), np.zeros_like(net.tables)])
    for was, now, g in zip((out, tables), (net.out, net.tables), gradients, strict=True):
        assert np.allclose(now, was - 0.05 * g / np.sqrt(g * g + 1e-8), atol=1e-4)


def test_pipeline(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame([(1, " ".join(corpus()[41][1].split()[:30]))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = step.columns, None
    for name, stage in corpus_pipeline.STAGES:
        step = corpus_pipeline.materialize(stage(spark, step, str(tmp_path)))
        now = {r["doc_id"] for r in step.collect()}
        assert ids is None or now <= ids
        assert name == corpus_pipeline.STAGES[-1][0] or step.columns == columns
        ids = now
    assert ids
    assert result(corpus_pipeline.run(spark, str(tmp_path))) == result(step)


def test_a_task_gives_back_what_it_freed(monkeypatch):
    from tablekin.llm import common

    given = []
    monkeypatch.setattr(common, "release", lambda: given.append(True))
    work = common.lean(lambda batches: (b + 1 for b in batches))
    assert list(work(iter([1, 2]))) == [2, 3] and given == [True]
    early = work(iter([1, 2]))
    assert next(early) == 2 and given == [True]
    early.close()
    assert given == [True, True]
    monkeypatch.undo()
    common.release()
