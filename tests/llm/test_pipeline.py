"""The corpus pipeline against a brute-force version, stage by stage, each on its own input."""

import importlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kind string, h1 long, row string, _qs_removed long"


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def say(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklm"), 5)) for _ in range(n))


def passed_rules(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    n, chars = len(words), sum(map(len, words))
    found = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    again = {i + k for i in range(n - 7) if found[tuple(words[i : i + 8])] > 1 for k in range(8)}
    repeated = len(lines) - len(set(lines))
    upper = sum(w.isupper() and len(w.encode()) > 1 for w in words)
    return not (
        n < 20 or 100 * len(again) > 30 * n or 100 * len(re.findall(r"[#*$%&|<>]", text or "")) > 20 * n or chars > 20 * n or 10 * chars < 15 * n
        or (repeated > 3 and 100 * repeated > 30 * len(lines)) or 100 * upper > 60 * n or 100 * words.count("|") > 20 * n
    )


def without_lines(rows):
    """Blocks of lines with 20 words that a smaller id holds as well go, blank lines between them too; then stubs."""
    runs = {}
    split = [[(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")] for _, t in rows]
    for (d, _), lines in zip(rows, split, strict=True):
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if d is not None:
                    key = tuple(x for _, x in lines[i:j])
                    runs[key] = min(d, runs.get(key, d))
    for (d, t), lines in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                key = tuple(x for _, x in lines[i:j])
                if d is not None and runs[key] < d and sum(len(x.split()) for x in key) >= 20:
                    gone |= set(range(i, j))
        cut = {lines[k][0] for k in gone}
        for k in gone:
            if k + 1 in gone:
                cut |= set(range(lines[k][0], lines[k + 1][0]))
        if not cut:
            yield d, t
        elif len(WORD.findall(kept := "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut))) >= 20:
            yield d, kept


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def without_copies(rows):
    texts = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], str(r[1])))
    sets, root = [shingles(t) for _, t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i][1] == texts[j][1] or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    stays = {texts[k] for k, r in enumerate(root) if r == k}
    return [r for r in rows if r[0] is None or r in stays]


def without_leaks(rows, items):
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    def leaks(text):
        w = norm(text)
        for m in map(norm, items):
            need = grams(m)
            for s in range(max(1, len(w) - len(m) + 1)) if need else ():
                have = grams(w[s : s + len(m)])
                if 5 * (have & need).total() >= 4 * (have | need).total() > 0:
                    return True
        return False

    return [r for r in rows if not leaks(r[1])]


def corpus():
    """Passages of several lines in very many documents, owners in another order, passages twice in a text, edits in one run, copies."""
    rng, rows = np.random.default_rng(3), []
    passage = [[say(9, 10 * k + i) for i in range(4)] for k in range(3)]
    for i in range(16):  # more documents than any rarity rule would let through
        rows.append((100 + i, "\n".join([say(15, 1000 + i), *passage[0], "", say(14, 2000 + i)])))
    rows.append((90, "\n".join([*passage[1][2:], say(30, 3001), *passage[1][:2]])))  # the owner holds the halves apart
    rows += [(120 + i, "\n".join([say(22, 3100 + i), *passage[1], say(8, 3200 + i)])) for i in range(3)]
    rows.append((130, "\n".join([say(21, 3301), *passage[2], say(3, 3302), *passage[2], say(12, 3303)])))
    rows.append((140, "\n".join([*passage[2], say(25, 3304), *passage[2]])))
    for k in range(8):  # near copies of one line each, so that line dedup leaves them whole
        w, other = say(120, 4000 + k).split(), say(40, 4100 + k).split()
        n = 4 + 2 * k
        edits = [w, w[:50] + other[:n] + w[50 + n :], w + other[:n], w[: 120 - n], w[n:], [*w[:30], "x", *w[31:80], "y", *w[81:]]]
        rows += [(200 + 10 * k + j, " ".join(e)) for j, e in enumerate(edits)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (rows[3][0], rows[3][1]), (None, rows[5][1]), (None, say(40, 5000)), (402, None), (403, ""), (404, "x " * 60), (405, "Word | " * 40)]
    rows += [(406, "\n".join([*passage[0], say(4, 5001)])), (407, "a\n" * 30), (408, say(30_000, 5002)), (409, say(12, 5003))]
    items = [say(45, 6000 + i) for i in range(4)]
    rows += [(500 + i, f"{say(30, 6100 + i)} {x} {say(20, 6200 + i)}") for i, x in enumerate(items[:3])]
    edited = items[3].split()
    edited[22] = "changed"
    rows += [(510, say(25, 6300) + " " + " ".join(edited)), (511, say(25, 6301) + " " + " ".join(items[3].split()[:20]))]
    rng.shuffle(rows)
    return [(None if d is None else int(d), t) for d, t in rows], [*items, None, "too few words"]


def test_stages(spark, tmp_path, pipeline):
    from quillspark.llm._common import stage

    rows, items = corpus()
    wide = [(d, t, "en", "s", len(t or ""), "k", 1, "r", 9) for d, t in rows]
    spark.createDataFrame(wide, COLUMNS).repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    brute = [
        lambda rows: [r for r in rows if passed_rules(r[1])],
        lambda rows: list(without_lines(rows)),
        without_copies,
        lambda rows: without_leaks(rows, [x or "" for x in items]),
    ]
    held = rows
    for (name, step), by_hand in zip(pipeline.STAGES[:-1], brute, strict=True):
        docs = stage(step(spark, docs, str(tmp_path)), "test")
        before, held = held, by_hand(held)
        got = docs.collect()
        assert docs.columns == columns, name
        assert Counter((r.doc_id, r.text) for r in got) == Counter(held), name
        assert len(held) < len(before) or held != before, name  # each stage has something to do
        assert all(r.n_chars == len(r.text) and (r.lang, r.kind, r.h1, r.row, r._qs_removed) == ("en", "k", 1, "r", 9) for r in got), name
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(path).encode
    pieces = stage(pipeline.STAGES[-1][1](spark, docs, str(tmp_path)), "test").collect()
    want = Counter()
    for d, t in held:
        want[d] += len(encode(t, add_special_tokens=False).ids) + 1
    assert Counter({d: sum(p.length for p in pieces if p.doc_id == d) for d in want}) == want and {p.doc_id for p in pieces} == set(want)
    for d, t in held:
        if d is not None and sum(x == d for x, _ in held) == 1:
            mine = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
            assert np.frombuffer(b"".join(bytes(p.ids) for p in mine), "<u4").tolist() == [*encode(t, add_special_tokens=False).ids, 2]
    filled = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id] and p.ids_crc32 == zlib.crc32(bytes(p.ids))
        filled[p.sequence_id] += p.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in filled.values())
    whole = pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in whole.select("doc_id").distinct().collect()) == Counter(set(want))


def test_empty_documents(spark, tmp_path, pipeline):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_are_found_among_those_that_line_dedup_leaves(spark, pipeline):
    """No pair of the stage's own input that is similar enough keeps both documents: recall against brute force is 1."""
    rng = np.random.default_rng(17)
    rows = []
    for k in range(25):
        base = say(100, 7000 + k).split()
        for j in range(8):
            w = list(base)
            for x in rng.integers(0, 100, rng.integers(0, 5)):
                w[x] = f"e{k}x{j}x{x}"
            rows.append((1000 * k + j, " ".join(w)))
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, df, "").collect()}
    assert kept == {d for d, _ in without_copies(rows)}
    importlib.reload(pipeline)
