"""Each training-data operator against a brute-force version on rows with nulls, empty texts, ties and clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strand.llm import exact_dedup, html_text, minhash, mixing, packing, pii, quality, secret_scan, substring, topk
from strand.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string, h long, slot string, n string, spans string"


def frame(spark, texts, ids=None, sources=None):
    ids = ids if ids is not None else list(range(len(texts)))
    sources = sources or ["s"] * len(texts)
    rows = [(i, t, s, 1, "x", "y", "z") for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(30, 120))] for _ in range(25)]
    out = [None, "", "  \n ", "one two", "One  two", "one two", "solo"]
    for b in base:
        out.append(" ".join(b))
    for _ in range(40):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            b[rng.randrange(len(b))] = word()
        out.append(" ".join(b))
    passage = " ".join(base[0][:25])
    out += [f"{word()} {passage} {word()}" for _ in range(6)]
    out += [" ".join(word() for _ in range(6000))]
    return out


def words(t):
    return (t or "").encode().split()


def test_exact_dedup(spark, texts):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
    for limit in (exact_dedup.FILTER_ITEMS, 1):  # in one range of hashes and in several
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(frame(spark, texts), filter_items=limit).collect()}
        assert got == want
    kept = exact_dedup.drop_exact_duplicates(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])
    assert kept.columns == frame(spark, texts).columns
    nulls = exact_dedup.exact_dedup(frame(spark, ["a", "a", "b"], [None, 7, None])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in nulls) == [(-1, -1, 1, True), (-1, 7, 2, False), (7, 7, 2, True)]
    assert exact_dedup.exact_dedup(frame(spark, [], [])).count() == 0


def components(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup(spark, texts, width):
    sets = {}
    for i, t in enumerate(texts):
        w = words((t or "").lower() if (t or "").isascii() else t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    want = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(frame(spark, texts), width=width).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_dedup_edges(spark):
    assert minhash.near_dedup(frame(spark, [], [])).count() == 0
    rows = minhash.near_dedup(frame(spark, ["a b c d e", "a b c d e", "a b c d e", "q"], [None, 3, 3, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (-1, 3, False), (3, 3, True), (3, 3, True)]


def test_near_dedup_short_texts(spark):
    """Pairs of 9 to 30 shingles just above the threshold, alone and in one bucket of many."""
    rng, texts = random.Random(11), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for n in (9, 10, 15, 20, 30):
        for _ in range(40):
            shared = [word() for _ in range(n + 2)]
            texts += [" ".join([*shared, *(word() for _ in range(n // 8))]), " ".join([*(word() for _ in range(n // 8)), *shared])]
    base = [word() for _ in range(12)]
    texts += [" ".join([*base, word()]) for _ in range(40)] + [" ".join([word(), *base]) for _ in range(40)]
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in enumerate(texts)}
    want = components(sets)
    assert len(set(want.values())) < len(texts) // 2 + 10
    assert {r.doc_id: r.component_id for r in minhash.near_dedup(frame(spark, texts)).collect()} == want


def bucket(spark, sketches, n):
    """Members of one bucket, ids from 0 up, as bucket_members has them."""
    rows = [(7, k, len(sketches), (k, n, s), (0, n, sketches[0])) for k, s in enumerate(sketches)]
    m = "struct<id:long,n:long,sketch:array<long>>"
    return spark.createDataFrame(rows, f"key long, ord long, members long, m {m}, centre {m}")


@pytest.mark.parametrize("members", [minhash.NEAR + 1, minhash.NEAR + 2])
def test_near_edges_limit_is_the_same_in_large_buckets(spark, members):
    rng = np.random.default_rng(2)
    sketches = rng.integers(-(2**63), 2**63, (members, 16), dtype=np.int64)
    sketches[2] = sketches[1]
    sketches[2, :2] ^= np.array([-1, (1 << 46) - 1])  # 64 + 46 bins of 512, within the limit of 125
    got = minhash.near_edges(bucket(spark, sketches.tolist(), 3000), spark.createDataFrame([], "node long, root long")).collect()
    assert {(r.a, r.b) for r in got} == {(2, 1)}


def test_near_edges_meets_all_parts_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 8)
    rows = bucket(spark, [[0] * 16] * 40, 10)
    for joined in ([], range(15, 40), range(40)):
        roots = spark.createDataFrame([(k, min(joined)) for k in joined], "node long, root long")
        got = [(r.a, r.b) for r in minhash.near_edges(rows, roots).collect()]
        assert sorted(got) == [(a, b) for a in range(40) for b in range(a) if not (a in joined and b in joined)]


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (8, 100, 1000):
        agree = []
        for _ in range(60):
            h = rng.integers(0, 2**63, n * 10 // 9, dtype=np.uint64)
            cut = len(h) - n
            agree.append((minhash.signature(np.unique(h[cut:])) == minhash.signature(np.unique(h[: n]))).mean())
        assert abs(np.mean(agree) - (2 * n - len(h)) / len(h)) < 0.05


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tok = Tokenizer.from_file(path)
    odd = texts + ["Ünïcode naïve ﬁ ½ 中文 İstanbul é", "it's <|endoftext|> we'll 123 x_y", "a\x1cb\x85c d", "x" * 3000]
    rows = packing.pack(frame(spark, odd), path, keep_ids=True).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in enumerate(odd):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(by[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(frame(spark, [], []), path).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(3)
    for case in range(30):
        cap = int(rng.integers(5, 60))
        lengths = rng.integers(1, cap + 1, int(rng.integers(1, 200)))
        histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        used = defaultdict(int)
        bins = 0
        for parts, times in packing.plan(histogram, cap):
            assert sum(parts) <= cap and times > 0
            bins += times
            for x in parts:
                used[x] += times
        assert dict(used) == histogram
        greedy = []
        for x in sorted(lengths, reverse=True):
            fit = [k for k, free in enumerate(greedy) if free >= x]
            if fit:
                k = min(fit, key=lambda k: greedy[k])
                greedy[k] -= x
            else:
                greedy.append(cap - x)
        assert bins <= len(greedy) + 1


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in np.round(rng.standard_normal(6), 1)]) for i in range(120)]
    vectors += [(130, None), (131, [1.0, None] + [0.0] * 4), (132, [float("nan")] * 6), (133, [float("inf")] * 6), (134, [0.0] * 6), (135, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df.filter("vec_id % 10 = 0"), df, 10).collect()]
    good = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sorted(good):
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=False)), c) for c in good if c != q)
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored[:10])]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.filter("false"), df).count() == 0 and topk.top_k(df.limit(1), df.limit(0)).count() == 0


def test_substring_dedup(spark, texts):
    rows = texts + [None, " ".join(["x"] * 60)]
    window = 20
    first, want = {}, {}
    for i, t in enumerate(rows):
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                gone.update(range(k, k + window))
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(frame(spark, rows)).collect()}
    assert got == want
    assert substring.substring_dedup(frame(spark, [], [])).count() == 0
    same = " ".join(map(str, range(30)))
    assert sorted((r.doc_id or -1, r.n_removed) for r in substring.substring_dedup(frame(spark, [same, same], [None, 4])).collect()) == [(-1, 30), (4, 0)]


def test_mixing(spark):
    rng = random.Random(2)
    n = 3000
    sources = [rng.choice(["a", "b", "b", "b", "c", "d", None]) for _ in range(n)]
    sources[:2] = ["tiny", "empty"]
    docs = [" ".join("w" * rng.randint(1, 40)) for _ in range(n)]
    docs[1] = None
    rows = mixing.mixed(frame(spark, docs, sources=sources)).collect()
    sizes = defaultdict(int)
    for t, s in zip(docs, sources, strict=True):
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in left) for s in order}
        over = {s for s in left if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in rows:
        assert r.mix_source_size == sizes[r.source] and abs(r.mix_target - target[r.source]) < 1e-6 and 0 <= r.mix_copies <= 3
        taken[r.source] += r.mix_size * r.mix_copies
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.1 * target[s] + 300
    again = mixing.mix_sources(frame(spark, docs, sources=sources))
    assert again.count() == sum(r.mix_copies for r in rows)
    assert mixing.mixed(frame(spark, [], [])).count() == 0


def test_quality(spark):
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)) + "."
    docs = [prose() if i % 3 else prose().upper().replace(" ", "!! ") for i in range(600)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(500)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.quality(frame(spark, docs), labels).collect()}
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in set(held)) for i in range(600))
    assert np.mean([out[i].predicted == int(i % 3 > 0) for i in held]) > 0.97
    none = quality.quality(frame(spark, docs[:5]), labels.filter("false")).collect()
    assert all(r.score == 0.5 for r in none)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav>
<div id="cookie-notice"><p>We use cookies, a long notice that nobody reads at all.</p></div>%s<form><label>Mail</label></form>
<section class="comments"><p>A reader wrote at great length about nothing in particular today.</p></section><footer>&copy; x</footer><script>var a="</p>"</script></body></html>"""
BODY = "<h1>Title &amp; more</h1><p>First  long\n paragraph<br>with <b>bold</b> text, and some more of it here.</p><p>Short.</p><ul><li>One<li>Two</ul><div class='ad'>Buy</div><p>Last &eacute;"
TEXT = "Title & more\nFirst long paragraph with bold text, and some more of it here.\nShort.\nOne\nTwo\nLast é"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html(spark, tag):
    rows = [(1, "u", PAGE % f"<{tag}>{BODY}</{tag}>", "old"), (2, None, None, "old"), (3, "u", "", "old"), (4, "u", "<nav>only</nav>", "old")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got == {1: (TEXT, len(TEXT)), 2: ("", 0), 3: ("", 0), 4: ("", 0)}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_pii_base():
    rng = random.Random(9)
    for _ in range(8000):
        t = "".join(rng.choice("a1.-+@ 2(5)9%4é") for _ in range(rng.randint(1, 40)))
        want = []
        for kind, p in PII.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m.group())
                if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                    continue
                want.append((kind, *m.span()))
        assert pii.base_spans(t) == want


def test_pii_field(spark):
    weights = pii.trained_weights()
    hits = total = false = 0
    for t, spans in pii._examples(300, 77):
        base = pii.base_spans(t)
        found = {*base, *pii.added_spans(t, base, weights)}
        hits, total, false = hits + len(found & set(spans)), total + len(spans), false + len(found - set(spans) - set(base))
    assert hits >= 0.95 * total and false <= 0.05 * total
    for text, kind, span in (
        ("reach joe at example dot com now", "email", "joe at example dot com"), ("host 192[.]168[.]1[.]1 is down", "ip", "192[.]168[.]1[.]1"),
        ("call 020 7946 0958 please", "phone", "020 7946 0958"), ("my card 4111.1111.1111.1111 expired", "card", "4111.1111.1111.1111"),
        ("jane (at) research (dot) department (dot) university (dot) edu", "email", "jane (at) research (dot) department (dot) university (dot) edu"),
    ):
        assert [(k, text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text), weights)] == [(kind, span)]
    for text in ("we met at the office. then", "on 2020-01-02 03:04:05 we", "Version 1.2.3", "the dot at noon"):
        assert pii.added_spans(text, pii.base_spans(text), weights) == []
    t = "call (555) 123-4567 or 0044 123 456 7890 now"
    rows = frame(spark, [None, "", "x a.b@c.de y", t])
    got = {r.doc_id: r for r in pii.find_pii(rows, redact=True).collect()}
    assert got[0].spans == got[1].spans == "" and got[2].spans == "email:2:10" and got[2].redacted == "x [email] y"
    assert got[3].n_phone == 0 and got[3].spans.count("phone") == 2


def segmentations(spans):
    """Every set of spans that don't overlap."""
    out = [[]]
    for s in sorted(spans, key=lambda s: (s[1], s[2])):
        out += [[*own, s] for own in out if not own or own[-1][2] <= s[1]]
    return out


def test_pii_field_by_enumeration():
    rng = np.random.default_rng(3)
    for text in ("tel 020 7946 0958 x", "a (at) b dot c dot d", "4111.1111.1111.1111"):
        lattice = pii.Lattice(text, pii._segments(text))
        place = {s: k for k, s in enumerate(lattice.spans)}
        weights = rng.standard_normal((len(pii.KINDS), len(pii.FEATURES)))
        scores = lattice.scores(weights)
        every = [([place[s] for s in own], sum(scores[place[s]] for s in own)) for own in segmentations(lattice.spans)]
        total, chance = lattice.marginals(scores)
        z = sum(np.exp(v) for _, v in every)
        assert total == pytest.approx(np.log(z))
        for k in range(len(lattice.spans)):
            assert chance[k] == pytest.approx(sum(np.exp(v) for own, v in every if k in own) / z)
        best = lattice.best(scores)
        assert sum(scores[place[s]] for s in best) == pytest.approx(max(v for _, v in every))
        data = [(lattice, np.array([0]))]
        value, gradient = pii.log_likelihood(data, weights, 0.01)
        for i, j in ((0, 0), (3, 1), (3, 2)):
            moved = weights.copy()
            moved[i, j] += 1e-6
            assert (pii.log_likelihood(data, moved, 0.01)[0] - value) / 1e-6 == pytest.approx(gradient[i, j], abs=1e-4)


def test_secrets(spark):
    rng = random.Random(6)
    pieces = ["token", "Secret", "api_key", "PASSWORD", '"', " ", "=", ":", "abcdefgh", "é𝒳", "AKIA", "AB12", "0123456789abcdef", "\n", "ff", "AKIA12345678"]
    texts = [None, ""] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    patterns = [(secret_scan.PATTERNS["assign"], 0), (r"AKIA[A-Z0-9]+", 16), (r"[0-9a-f]+", 32)]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = []
        for k, (p, least) in enumerate(patterns):
            want += [(m.start(), k, m.end()) for m in re.finditer(p, t or "") if (len(m.group(2)) >= 8 if k == 0 else len(m.group()) >= least)]
        listed = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(want))
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x[1] == k for x in want) for k in range(3)]
        assert set(filter(None, listed.split(","))) <= set(got[i].spans.split(","))


def test_secret_battery(spark):
    """Random tokens of six encodings among twenty times as many of words: few false ones, and more found the longer they are."""
    rng = random.Random(8)
    pools = {"hex": "0123456789abcdef", "low": "abcdefghijklmnopqrstuvwxyz", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789"}
    pools["letters"] = pools["low"] + pools["low"].upper()
    pools["base64"] = pools["letters"] + "0123456789+/"
    words = "the and of version report final copy this with that file name document january service account holder street number".split()
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    shapes = [lambda: "".join(w.title() for w in pick(4)), lambda: "_".join(pick(4)) + str(rng.randrange(999)), lambda: "/".join(pick(5)), lambda: "-".join(pick(4)) + "-2024-01-02", lambda: "".join(pick(5)) + str(rng.randrange(9999))]
    tokens = [("word", shapes[k % len(shapes)]()) for k in range(2400)] + [(kind, "".join(rng.choice(pool) for _ in range(n))) for kind, pool in pools.items() for n in (24, 31, 64) for _ in range(7)]
    got = {r.doc_id: len(r.added) for r in secret_scan.scan_secrets(frame(spark, [f"some {t} text" for _, t in tokens])).collect()}
    false = sum(got[i] for i, (kind, _) in enumerate(tokens) if kind == "word")
    found = {n: [got[i] for i, (kind, t) in enumerate(tokens) if kind not in ("word", "hex") and len(t) == n] for n in (24, 31, 64)}
    assert false <= 0.02 * sum(got.values()) and np.mean(found[64]) >= 0.9 and np.mean(found[31]) >= 0.4
    hexes = [got[i] for i, (kind, t) in enumerate(tokens) if kind == "hex" and len(t) < 32]
    assert sum(hexes) >= 4  # those of 32 and more are base spans
    numbers = frame(spark, ["12345678901234567890", "2024-01-02-report-final-copy", "aaaaaaaaaaaaaaaaaaaaaaaa1"])
    assert not any(r.added for r in secret_scan.scan_secrets(numbers).collect())
