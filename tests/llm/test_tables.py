"""Packing, rules, mixing, pages: against brute force, on odd rows too."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import html_text, mixing, packing, quality_rules
from tidewater.llm.common import durable

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---------------------------------------------------------------- packing


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_word_ids_are_the_tokenizers():
    path, real = tokenizer()
    words = packing.encoder(path)
    rng = random.Random(1)
    letters = "aAbZzéÉñßÿÜªºµ.,!'*0٣字Σς İıſḰ­\x85\xa0\x0b\x1c \n\t-_<|>"
    special = ["<|endoftext|>", "<|startoftext|>", "don't", "we'll", "é"]
    for _ in range(8000):
        text = "".join(rng.choice(letters) if rng.random() < 0.93 else rng.choice(special) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(packing.token_bytes(words, text.encode()), "<u4").tolist() == [*real.encode(text, add_special_tokens=False).ids, 1], text


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_everything(seed):
    rng = np.random.default_rng(seed)
    many = rng.lognormal(6.3, 1.3, [0, 40, 3000, 60000][seed]).astype(int)
    histogram = np.bincount(np.clip(many, 1, 4096), minlength=4097)
    plan = packing.pack_counts(histogram)
    held = Counter()
    for items, n in plan:
        assert n > 0 and sum(v * t for v, t in items) <= 4096
        for v, t in items:
            held[v] += t * n
    assert held == {v: n for v, n in enumerate(histogram.tolist()) if n}
    least = -(-int((histogram * np.arange(4097)).sum()) // 4096)
    assert sum(n for _, n in plan) <= max(least + 1, 1.01 * least)


def test_nnls_finds_the_fit():
    kinds = packing.patterns(16)
    assert all(14 <= k.sum() <= 16 for k in kinds) and len({tuple(k) for k in kinds}) == len(kinds)
    rng = np.random.default_rng(2)
    truth = np.zeros(len(kinds))
    truth[rng.choice(len(kinds), 5, replace=False)] = rng.integers(5, 50, 5)
    b = packing._used(kinds, truth, 16)
    x, done = packing.nnls(kinds, b)
    assert done and (x >= 0).all() and np.abs(packing._used(kinds, x, 16) - b).max() < 1e-3
    # no fit is better: at the least squares no pattern's gradient points inwards
    b = b + rng.integers(0, 30, 17)
    b[0] = 0
    x, done = packing.nnls(kinds, b)
    gain = (b - packing._used(kinds, x, 16))[kinds]
    gain = np.where(kinds > 0, gain, 0).sum(1)
    assert done and gain.max() < 1e-3 * b.max() and np.abs(gain[x > 0]).max() < 1e-3 * b.max()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_patterns_place_most_pieces(seed):
    """The rounded fit can be carried out, and best fit only gets the rest."""
    rng = np.random.default_rng(seed)
    many = np.clip(rng.lognormal(6.5, 1.0, [0, 300, 5000, 60000][seed]).astype(int), 1, 4096)
    by_bin = np.bincount((many + 31) // 32, minlength=129)
    kinds, repeats = packing.fitted(by_bin)
    assert (packing._used(kinds, repeats, 128) <= by_bin).all() and (repeats > 0).all()
    count = np.bincount(many, minlength=4097)
    made = packing.by_patterns(count)
    assert sum(n for _, n in made) == repeats.sum()
    assert count.min() >= 0 and sum(n * sum(t for _, t in items) for items, n in made) + count.sum() == len(many)
    assert count.sum() < [0, 0.5, 0.1, 0.05][seed] * len(many)


def test_packing(spark):
    path, real = tokenizer()
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma,", "42", "délta"]) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    texts += ["word " * 9000, None, "", "word " * 4095, "word " * 4096]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(None, "a b", 0), (0, texts[0], 0)], "doc_id long, text string, length int").repartition(4)
    got = packing.packed(docs, path).collect()
    want = Counter()
    for d, t in [*enumerate(texts), (None, "a b"), (0, texts[0])]:
        ids = [*real.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[d, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.packed(docs.limit(0), path).count() == 0


# ---------------------------------------------------------------- rules


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def brute_verdicts(rows):
    counts = [brute_counts(t) for _, t, _ in rows]
    at = {n: k for k, n in enumerate(quality_rules._COUNTS)}
    rates, limits = {}, {}
    for r, (a, b, limit, _) in quality_rules.RULES.items():
        fails = [c[at[a]] > limit * c[at[b]] for c in counts]
        by = defaultdict(list)
        for f, (_, _, s) in zip(fails, rows, strict=True):
            by[s].append(f)
        m = sum(fails) / len(rows)
        v = sum(len(x) * (sum(x) / len(x) - m) ** 2 for x in by.values()) / len(rows)
        s = 10000 if v <= 0 else max(1, min(10000, m * (1 - m) / v - 1))
        limits[r] = m + 0.5 * math.sqrt(m * (1 - m) / (s + 1))
        for host, x in by.items():
            rates[r, host] = (sum(x) + s * m) / (len(x) + s)
    out = []
    for (d, _, host), c in zip(rows, counts, strict=True):
        base = c[0] < 50 or 100 * c[4] > 50 * c[0]
        failed = [r for r, (a, b, limit, strict) in quality_rules.RULES.items() if c[at[a]] > (strict if rates[r, host] > limits[r] else limit) * c[at[b]]]
        out.append((d, *c[:5], base, ",".join(failed), not base and not failed))
    return out


def test_rules(spark):
    rng = random.Random(5)
    rows = []
    for k in range(200):
        host = rng.choice(["good", "good", "bad", None])
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(30, 120))]
        if rng.random() < (0.8 if host == "bad" else 0.1):
            words = [w + rng.choice(["***", "", "#"]) for w in words]
        elif host == "bad":
            words = [w + "#" * (k % 3 == 0) for k, w in enumerate(words)]
        if rng.random() < 0.2:
            words = words[: len(words) // 3] * 3
        rows.append((k, rng.choice([" ", "\n", " \x0b"]).join(words), host))
    rows += [(900, None, "good"), (901, "", None), (None, "é x y\n\n \ny", "good"), (0, *rows[0][1:]), (903, "same line\n" * 50, "good")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_words int")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept"]
    got = Counter(tuple(r[c] for c in columns) for r in quality_rules.quality_verdicts(docs).collect())
    want = brute_verdicts(rows)
    assert got == Counter(want)
    strict = [w for w, r in zip(want, rows, strict=True) if r[2] == "bad" and "symbols" in w[7] and w[3] <= 0.5 * w[1]]
    assert strict  # the host's verdict changes that of some documents
    assert quality_rules.quality_verdicts(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing


def test_hosts_decide_on_given_data(spark):
    """On the driver's documents some hosts aren't trusted, and documents go for it that stay elsewhere."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    measured = durable(quality_rules.measure(docs))
    hosts = quality_rules.host_rates(measured).collect()
    assert 0 < sum(h[f"rate_{r}"] > h[f"limit_{r}"] for h in hosts for r in quality_rules.RULES) < len(hosts)
    kept = quality_rules.quality_verdicts(docs).where("kept").select("doc_id")
    alone = quality_rules.quality_verdicts(docs, deviations=1e9).where("kept").select("doc_id")
    assert kept.exceptAll(alone).count() == 0
    assert 0 < alone.exceptAll(kept).count() < 0.05 * docs.count()


def brute_targets(sizes):
    weights = dict(zip(sizes, [3, 1, 2] * len(sizes), strict=False))
    target = {s: 0.0 for s in sizes}
    left, open_ = 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 7}, {"a": 1, "b": 1, "c": 1000, "d": 5, None: 300}, {"a": 5}, {"Z": 50, "a": 50, "é": 0, None: 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)
    assert math.isclose(sum(got.values()), 1.5 * sum(sizes.values()))


def test_mix(spark):
    rng = random.Random(6)
    rows = [(k, "w " * rng.randint(0, 60), rng.choice(["a", "b", "b", "b", "c", "d", None])) for k in range(3000)]
    rows += [(9000, None, "a"), (9001, "", None), (None, "x y z", "b"), (0, *rows[0][1:])]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, source string, target string")
    first = mixing.mix_report(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in first) == Counter((d, size(t)) for d, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = brute_targets({s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))})
    taken = Counter()
    by_id = {d: s for d, _, s in rows}
    for r in first:
        assert r.taken <= 2 * r["size"] and math.isclose(r.target, want[by_id[r.doc_id]]) and r.source_size == sizes[by_id[r.doc_id]]
        taken[by_id[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 60)
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.source] += size(r.text)
    assert got == +taken
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("doc", [None, 7])
def test_mix_of_rows_alike(spark, doc):
    """Rows of one id, alike or not, come as near to the target as others."""
    rows = [(doc, "w x y", "a", k) for k in range(2001)] + [(doc, f"{k} " * (k % 50), "b", k) for k in range(2000)] + [(None, None, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(5)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    for size, t in target.items():
        assert abs(taken[size] - t) <= 25
    again = mixing.mix_report(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = Counter()
    for r in mixing.mixed(docs).collect():
        mixed[r.source] += len((r.text or "").split())
    assert [mixed[s] for s in "ab"] == [taken[6003], taken[sum(k % 50 for k in range(2000))]]


# ---------------------------------------------------------------- pages

FRAME = (
    '<!DOCTYPE html><html><head><title>t {k}</title><style>p{{}}</style><script>var x="</p>";</script></head><body>'
    '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Link {k}</a></li></ul></nav><!-- ad --><div class="ad">Buy {k}</div>'
    '<div class="notes">Seen everywhere.</div><{main}><h1>Title {k}</h1><p><b>First &amp; &eacute;{k}.<br><p>Second\n  line {k}</p>'
    '<div class="comments"><p>Reader {k}</p></div></{main}><aside>Side {k}</aside><form>Mail</form><footer>&copy; {k}</footer></body></html>'
)


def test_pages(spark):
    rows = [(k, f"http://Host.example:80/{k}", FRAME.format(k=k, main="article")) for k in range(6)]
    rows += [(10 + k, f"https://other.example/{k}", FRAME.format(k=k, main="div")) for k in range(6)]
    rows += [(30, None, None), (31, "x", ""), (None, "https://lone.example/", "<p>Only text, a &lt; b &amp; c<p>and <i>more</i>"), rows[0], (33, "//a", "x" * 300_000 + "<nav>n")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = html_text.main_text(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
    text = {r.page_id: r.text for r in got}
    for k in range(6):
        body = f"Title {k}\nFirst & é{k}.\nSecond line {k}"
        assert text[k] == body
        assert text[10 + k] == body  # without an article the repeated notice goes by the template
    assert text[30] == text[31] == "" and text[None] == "Only text, a < b & c\nand more" and text[33] == "x" * 300_000
    assert html_text.main_text(pages.limit(0)).count() == 0


def parsed(spark, rows):
    return durable(spark.createDataFrame(rows, "page_id long, url string, html string").mapInArrow(html_text._parse, html_text._PARSED))


def brute_classes(rows, least=4, part=0.5):
    """Sets of tokens with equal occurrence vectors, written out."""
    pages = [Counter(t for t, _ in html_text.Page(h).order) for _, _, h in rows]
    by = defaultdict(set)
    for t in set().union(*pages):
        by[tuple(p[t] for p in pages)].add(t)
    n = len(rows)
    on = lambda v: sum(x > 0 for x in v)
    return {frozenset(c) for v, c in by.items() if on(v) >= max(least, part * n) and (len(c) > 1 or v == (1,) * n)}


@pytest.mark.parametrize("times", [1, 2])
def test_classes_are_those_of_occurrence_vectors(spark, times):
    """Classes are found as by brute force, and repeated rows leave them as they are."""
    rng = random.Random(4)
    part = lambda k: "".join(f"<div class=c{j}><p>{rng.choice(['same', 'other', f'own {k} {j}'])}</p></div>" * rng.randint(0, 2) for j in range(5))
    rows = [(k, "http://h.example/", f"<body><div class=a><p>Title {k}</p><p>fixed</p>{part(k)}<p>end</p></div></body>") for k in range(24)]
    found = html_text.classes(parsed(spark, rows * times)).first().tokens
    got = defaultdict(set)
    for t in found:
        got[t["class"]].add(t["token"])
    assert {frozenset(c) for c in got.values()} == brute_classes(rows)


def test_template_is_a_tree_of_ordered_classes(spark):
    rng = random.Random(6)
    rows = []
    for k in range(20):
        mixed = ["<p>left</p>", "<p>right</p>"]
        rng.shuffle(mixed)
        inner = "<section><p>head</p><p>foot</p></section>" if k % 4 else ""
        rows.append((k, "http://h.example/", f"<body><div class=a><p>top</p><p>own {k}</p>{inner}<div class=m>{''.join(mixed)}</div><p>bottom</p></div></body>"))
    found = html_text.templates(parsed(spark, rows)).first()
    template = html_text.Template(found.template, found.tree)
    token = lambda path, text="": html_text._hash(f"{path}\0{text}" if text else path)
    at = "/body/div.a"
    root, inner = template.of[token(f"{at}/p", "top")], template.of[token(f"{at}/section")]
    assert template.of[token(f"{at}/p", "bottom")] == root != inner and template.parent[inner] == root
    # "left" and "right" are on every page once, as the root's tokens are, but in no order: the root is valid without them
    assert token(f"{at}/div.m/p", "left") not in template.of
    text = html_text.Layout.of(html_text.Page(rows[1][2])).main_text(template).split("\n")
    assert sorted(text) == ["left", "own 1", "right"]


def test_slots_decide_on_given_pages(spark):
    """On the driver's pages of hosts with a template, tags of valid classes cut the page into slots, and the text is that of one slot, or of a part of it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    lay = durable(pages.mapInArrow(html_text._parse, html_text._PARSED))
    trees = {r.host: html_text.Template(r.template, r.tree) for r in html_text.templates(lay).collect()}
    rows = [r for r in lay.collect() if r.host in trees]
    assert len(rows) > 150
    for r in rows:
        page = html_text.Layout(r.tokens, r.block, r.texts, r.flags, r.cues)
        slots = [[r.texts[b] for b in s] for s in page.slots(trees[r.host])]
        text = page.main_text(trees[r.host]).split("\n")
        assert len(slots) > 1 and sum(set(text) <= set(s) for s in slots) == 1


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><header><h1>T</h1></header><ul><li>1<li>2</ul><table><tr><td>x<td>y</table><p>1 < 2 &nbsp; z</article>tail", "T\n1\n2\nx y\n1 < 2 z"),
        ("<main><p>a</p></main><div id=sidebar>no</div>", "a"),
        ('<div class="cookie-notice">no</div><p title="a>b">yes</p>', "yes"),
        ("<p>a<script>if (a</script", "a"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
        ("</div></p>text", "text"),
        ("<article><p>&#x41;&#66;&bogus; <em>c</em>d</p></article>", "AB&bogus; cd"),
        ("<!-- never closed <p>x", ""),
        ("plain", "plain"),
    ],
)
def test_page_text(html, text):
    assert html_text.Layout.of(html_text.Page(html)).main_text() == text


def test_template_inside_articles(spark):
    """Repeated blocks inside articles go; what copies of one article share stays."""
    note = "<p>Read more from our partners.</p><p>All rights kept.</p>"
    rows = [(k, f"http://h.example/{k}", f"<article><h1>Title {k}</h1><p>Own {k}</p>{note}</article>") for k in range(6)]
    rows += [(10 + k, f"http://h.example/{k}", f"<article><h1>Copied</h1><p>Shared by copies.</p><p>Ending {k}</p>{note}</article>") for k in range(8)]
    rows += [(30 + k, f"http://same.example/{k}", "<main><h1>Same</h1><p>On each page.</p></main>") for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    for k in range(6):
        assert text[k] == f"Title {k}\nOwn {k}"
    for k in range(8):
        assert text[10 + k] == f"Copied\nShared by copies.\nEnding {k}"
    for k in range(5):
        assert text[30 + k] == "Same\nOn each page."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body class='single-post right-sidebar'><article><p>a</p></article></body>", "a"),
        ("<body class='comments-open'><p>a</p></body>", "a"),
        ("<main class='post-content with-sidebar'><p>a</p></main>", "a"),
        ("<div class='layout with-sidebar'><article><p>a</p></article><div class=sidebar>no</div></div>", "a"),
        ("<article><p>a</p><section class='related-work'><p>b</p></section></article>", "a\nb"),
        ("<article><p>a</p></article><div class=related><article><p>teaser</p></article></div>", "a"),
        ("<article><p>a</p><div class='related-posts'><p>no</p></div></article>", "a"),
    ],
)
def test_cues_leave_wrappers_alone(html, text):
    assert html_text.Layout.of(html_text.Page(html)).main_text() == text


def test_template_decides_on_cues_inside_articles(spark):
    once = "<div class=notice><p>Only here.</p></div>"
    rows = [(k, f"http://h.example/{k}", f"<article><h1>Title {k}</h1><p>Own {k}</p>{once if k == 3 else ''}<div class=comments><p>Reader {k}</p></div></article>") for k in range(6)]
    text = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert text[k] == f"Title {k}\nOwn {k}" + ("\nOnly here." if k == 3 else "")
