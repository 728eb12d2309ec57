"""The single-task parts of the operators against brute force, on generated inputs."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import _blocks, _common, _components, html_extract, line_dedup, packing, pii, quality, secrets, simhash_dedup, substring_dedup, suffix_dedup

words = st.text("ab", min_size=1, max_size=2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b))), min_size=1, max_size=6), st.integers(1, 9))
def test_bwt_repeats(rows, depth):
    docs = np.array([d for d, _ in rows], np.int64)
    bodies = [b for _, b in rows]
    body, a, b = suffix_dedup.repeats(bodies, docs, depth)
    got = [bytearray(len(x)) for x in bodies]
    for i, x, y in zip(body, a, b, strict=True):
        got[i][x:y] = b"\1" * (y - x)
    want = [bytearray(len(x)) for x in bodies]
    for i, (d, x) in enumerate(rows):
        for k in range(len(x) - depth + 1):
            if any(e < d and x[k : k + depth] == y[m : m + depth] for e, y in rows for m in range(len(y) - depth + 1)):
                want[i][k : k + depth] = b"\1" * depth
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(words, max_size=25)), min_size=1, max_size=6), st.integers(2, 6))
def test_lempel_ziv_spans(rows, least):
    rows = [r for r in rows if r[1]] or [(0, ["a"])]
    docs = np.array([d for d, _ in rows], np.int64)
    zero = np.zeros(len(rows), np.int64)
    bodies = [" ".join(w).encode() for _, w in rows]
    crc, a, b = substring_dedup._settle(least)(zero, docs, bodies)
    got = [[0] * len(w) for _, w in rows]
    for i, x, y in zip(crc, a, b, strict=True):
        got[i][x:y] = [1] * (y - x)
    want = [[0] * len(w) for _, w in rows]
    for i, (d, w) in enumerate(rows):
        for k in range(len(w) - least + 1):
            if any(e < d and w[k : k + least] == v[m : m + least] for e, v in rows for m in range(len(v) - least + 1)):
                want[i][k : k + least] = [1] * least
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=4), st.integers(2, 4), st.integers(5, 12))
def test_equal_windows_have_equal_anchors(texts, gram, window):
    unit, bounds = suffix_dedup._hashes(texts)
    at, h = _blocks.anchors(unit, bounds, window, gram)
    seen = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - window + 1):
            lo = bounds[i] + k
            inside = sorted((int(p - lo), int(x)) for p, x in zip(at, h, strict=True) if lo <= p <= lo + window - gram)
            assert inside
            least = min(x for _, x in inside)
            key = [(p, x) for p, x in inside if x == least]
            assert seen.setdefault(t[k : k + window], key) == key


def test_anchors_of_a_long_text_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 100, n).tolist()) for n in (3, 700, 60, 2500)]
    unit, bounds = suffix_dedup._hashes(texts)
    whole = _blocks.anchors(unit, bounds, 50, 20)
    monkeypatch.setattr(_blocks, "PIECE", 200)
    pieces = _blocks.anchors(unit, bounds, 50, 20)
    assert [x.tolist() for x in whole] == [x.tolist() for x in pieces]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignments(a, b):
    pairs = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    x, y = html_extract.shared_lines(a, b)
    assert [a[i] for i in x] == [b[j] for j in y] and x == sorted(set(x)) and y == sorted(set(y))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
    assert len(x) == best[-1][-1]
    if len(set(a)) == len(a) and a == b:
        assert pairs == [(i, i) for i in range(len(a))]
    halved = html_extract._halved(a, b, 0, 0)
    assert len(halved) == len(x) and all(a[i] == b[j] for i, j in halved)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(halved, halved[1:], strict=False))


def test_alignment_of_very_many_equal_lines():
    a, b = [1, 2] * 4000 + [3], [2] * 5000 + [1] * 3000 + [4]
    x, y = html_extract.shared_lines(a, b)
    assert len(x) == 4000 + 1 or len(x) >= 4000
    assert [a[i] for i in x] == [b[j] for j in y] and x == sorted(set(x)) and y == sorted(set(y))


BASE_PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_pii(text):
    for kind, p in BASE_PII.items():
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x.lstrip("0")[:4] or 0) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield kind, m.start(), m.end()


@settings(max_examples=400, deadline=None)
@given(st.text("a@.-+ 012é%()", max_size=40))
def test_pii_base_spans(text):
    assert list(pii.base_spans(text)) == list(base_pii(text))


def test_pii_validators():
    assert pii.luhn("4495589438270767") and not pii.luhn("4495589438270768")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    kinds = [s["kind"] for s in pii.find_pii("iban GB82 WEST 1234 5698 7654 32 social 123-45-6789, call (212) 555-0100, code 123-45-6780")]
    assert kinds == ["iban", "ssn", "local_phone"]
    assert pii.find_pii("") == []


@pytest.mark.parametrize("text", ["1" * 200_000, "a." * 100_000 + "@", "@" * 200_000, "+" + "1 " * 100_000, "a@" + "b-" * 100_000, "1.2.3.4 212 555 0100 " * 20_000])
def test_pii_is_linear(text):
    pii.find_pii(text)


@pytest.mark.parametrize("text", ["0" * 5000 + "1.2.3.4", "1.2.3." + "9" * 5000, "1.2.3." + "0" * 5000, "1." + "0" * 4999 + "256.1.1"])
def test_pii_of_very_long_numbers(text):
    assert list(pii.base_spans(text)) == list(base_pii(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["1.2.3.4", "212 555 0100", " call ", "123-45-6789", "ssn ", " ", "+1 (858) 555-2128", "example "]), max_size=8).map("".join))
def test_pii_further_spans_avoid_base_spans(text):
    found = pii.find_pii(text)
    taken = [(s["start"], s["end"]) for s in found if s["kind"] in pii.BASE]
    for k, a, b in pii._extra(text):
        free = not any(a < y and x < b for x, y in taken)
        assert (free and pii.score(text, k, a) >= 0.5) == any((s["kind"], s["start"], s["end"]) == (k, a, b) for s in found)


def test_word_ids_of_all_letters():
    """Each code point beside a full stop, a comma and a letter, against the vocabulary on the whole text."""
    names = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    ids = packing.WordIds(names.path("word_bpe_49k.json"))
    assert ids.by_word
    texts = [x for c in map(chr, (*range(0x21, 0xD800), *range(0xE000, 0x30000))) for x in (f"{c}.", f"{c},", f"a{c}.", f"{c}a b{c} ")]
    texts += ["don't.", "Hello,World.", "<|endoftext|>a.", "x<|endoftext|>, y", "a\u0301b \u0301.", "'s.", " ", ""]
    for got, want in zip(texts, Tokenizer.from_file(names.path("word_bpe_49k.json")).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids.of(got.encode()), "<u4").tolist() == want.ids, got


def test_word_ids_of_another_vocabulary():
    names = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    ids, whole = packing.WordIds(names.path("byte_bpe_50k.json")), Tokenizer.from_file(names.path("byte_bpe_50k.json"))
    assert not ids.by_word
    for text in ("Two  Words.\n\nMore, of them", "", " "):
        assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "é"]), max_size=60), st.sampled_from([" ", "\n", "\t", "\x0b"]))
def test_repeated_words(ws, sep):
    text = sep.join(ws)
    found = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    mark = [0] * len(ws)
    for i, w in enumerate(found):
        if found.count(w) > 1:
            mark[i : i + 8] = [1] * 8
    m = dict(zip(quality.MEASURES, quality.measure(text.encode()), strict=True))
    assert (m["n_words"], m["word_chars"], m["n_repeat_words"]) == (len(ws), sum(map(len, ws)), sum(mark))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=25), st.integers(1, 4))
def test_packer(sizes, most):
    p = packing.Packer(16, most, 0)
    ids = [np.arange(n, dtype="<u4").tobytes() for n in sizes]
    for i, x in enumerate(ids):
        p.place(i, x)
        assert len(p.windows) <= most
    p.finish()
    rows, sequences = {}, {}
    for doc, start, n, part, total, seq, at in p.out:
        assert n > 0 and len(part) == 4 * n and total == sizes[doc]
        rows.setdefault(doc, []).append((start, part))
        sequences.setdefault(seq, []).append((at, n))
    assert all(b"".join(x for _, x in sorted(v)) == ids[d] for d, v in rows.items()) and len(rows) == len(sizes)
    for v in sequences.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= 16 and end & (end - 1) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.lists(st.integers(0, 63), max_size=9), st.sampled_from([4, 5, 7]))
def test_deletion_variants_meet(prints, flips, radius):
    other = prints[0]
    for f in set(flips[:radius]):
        other ^= 1 << f
    both = np.array([prints[0], other], np.uint64)
    assert any(k[0] == k[1] for k in simhash_dedup.variant_keys(both, radius))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 15)), min_size=1, max_size=40))
def test_close_pairs(rows):
    rows.sort()
    key, p = np.array([k for k, _ in rows], np.uint64), np.array([v for _, v in rows], np.uint64)
    got = sorted((int(i), int(j)) for a, b in simhash_dedup.close_pairs(key, p, 1) for i, j in zip(a, b, strict=True))
    assert got == [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][0] == rows[j][0] and bin(rows[i][1] ^ rows[j][1]).count("1") <= 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=40))
def test_forest(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    child, top = _components.forest(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    want = {x: find(x) for x in root if find(x) != x}
    assert dict(zip(child.tolist(), top.tolist(), strict=True)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 12), max_size=9), st.integers(0, 1)), min_size=1, max_size=14), st.sampled_from([0.5, 0.8]))
def test_tile_links(rows, similarity):
    sets = [np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s, _ in rows]
    sets = [np.unique(s) for s in sets]
    block = np.array([b for _, b in rows])
    links = set()
    for i, (s, x) in enumerate(rows):
        for j, (t, y) in enumerate(rows[:i]):
            if (x != y or block.min() == block.max()) and s & t and len(s & t) >= similarity * len(s | t):
                links.add((i, j))
    u, v = simhash_dedup.tile_links(sets, block, similarity)
    want = _components.forest(np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64)) if links else ([], [])
    assert sorted(zip(u, v, strict=True)) == sorted(zip(*want, strict=True))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 63), st.integers(0, 2**32), st.sampled_from([4, 7]))
def test_links_of_large_variants(base, bit, seed, radius):
    """Entries of one variant, more than are compared pair by pair, against all pairs."""
    rng = np.random.default_rng(seed)
    p = np.array([base], np.uint64) ^ np.array([sum(1 << int(b) for b in rng.integers(24, 64, rng.integers(0, 6))) & (2**64 - 1) for _ in range(150)], np.uint64)
    key, node = np.zeros(len(p), np.uint64), np.arange(len(p))
    simhash_dedup.LARGE, before = 20, simhash_dedup.LARGE
    try:
        got = simhash_dedup.linked(key, p, node, radius)
    finally:
        simhash_dedup.LARGE = before
    i, j = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p[None, :]) <= radius, 1))
    want = _components.forest(i, j) if len(i) else ([], [])
    assert sorted(zip(*got, strict=True)) == sorted(zip(*want, strict=True))


def test_shingle_hashes_and_fingerprint():
    import xxhash

    assert len(simhash_dedup.shingle_hashes(b"", 4)) == 0 and simhash_dedup.fingerprint(np.zeros(0, np.uint64)) == 0
    h = simhash_dedup.shingle_hashes("A bÉ\tc".encode(), 4)
    assert h.tolist() == [xxhash.xxh64_intdigest("a bÉ c".encode(), 42)]
    assert simhash_dedup.fingerprint(h) == int(h[0])
    assert len(simhash_dedup.shingle_hashes(b"a b c d e", 4)) == 2


def test_html_blocks():
    page = (
        "<body><header><h1>Site</h1></header><nav>a</nav><article class='post'><header><h1>T &amp; x</h1></header><p>one<p>two <b>b</b>\n c<br>d"
        "<div class='comments-list'><p>nice</p></div><!-- <p>no --><p>th&eacute;e &am</article><div id='cookieNotice'>x</div><script>var a='</p>';</script><p>foot <a hre"
    )
    b = html_extract.blocks(page)
    assert [t for t, z in b if z == html_extract.MAIN] == ["T & x", "one", "two b c d", "thée &am"]
    assert [t for t, z in b if z == html_extract.PLAIN] == ["foot"]
    assert html_extract.blocks("") == [] and html_extract.blocks("a < b <") == [("a < b <", html_extract.PLAIN)]
    html_extract.blocks("<a x='" * 20_000)
    html_extract.blocks("<div>" * 20_000)


def test_blobs_and_groups():
    a = np.array([1, 2, 3], np.uint32)
    assert [x.tolist() for x in _common.unpack(_common.pack(a, a.astype(np.int64)))] == [[1, 2, 3]] * 2
    assert _common.group_of(np.array([-5, 0, 7, 2**40]), 8).min() >= 0
    assert zlib.crc32(b"") == 0


def test_secret_patterns_have_known_kinds():
    assert [p[0] for p in secrets.PATTERNS][:3] == list(secrets.BASE)


def test_staged_tables(spark):
    import os

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = _common.stage(spark.range(10).selectExpr("id % 3 k", "id").groupBy("k").count(), "test")
    assert os.path.isdir(df._qs_path) and df.count() == 3 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    _common.unstage(df)
    assert not os.path.exists(df._qs_path)


def test_no_temporary_folder_on_a_cluster():
    class Conf:
        values: dict = {}

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    for master in ("spark://somewhere:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        Context.master = master
        with pytest.raises(ValueError):
            _common.shared_dir(Session())
    for master in ("local", "local[4]", "local[*]"):
        Context.master, Conf.values = master, {}
        assert _common.shared_dir(Session())


def test_buckets_use_all_low_bits():
    h = np.random.default_rng(1).integers(0, 2**64, 1 << 18, dtype=np.uint64)
    b = _common.bucket_of(h, 1 << 20)
    assert b.min() >= 0 and b.max() < 1 << 20 and len(np.unique(b)) > 0.2 * (1 << 20)


def test_unknown_sizes_are_measured(spark):
    rows = spark.createDataFrame([("x" * 1000,)] * 50, "text string")
    unknown = rows.rdd.toDF(rows.schema)
    assert 50_000 <= _common.input_bytes(unknown) <= 60_000 or _common.input_bytes(unknown) < 1 << 60
