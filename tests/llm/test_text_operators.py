"""The operators on texts against brute force: repeated, null, empty, long and odd texts."""

import base64
import hashlib
import random
import re
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from postlens.llm.op10_substring_dedup import _send, remove_repeats
from postlens.llm.op3_near_dedup import _BAND, near_duplicates
from postlens.llm.op5_iblt import compare_with_next, differences, elements
from postlens.llm.op6_language import fit, held_out, predict
from postlens.llm.op7_token_counts import count_tokens
from postlens.llm.op8_byte_bpe import decode, encode, round_trip
from postlens.llm.op9_packing import PIECES, _round, best_fit, pack, token_pieces
from postlens.llm.superminhash import SLOTS
from tests.llm.conftest import rows_of

ODD = ["", None, " \n\t ", "a  b", "x \n y", "a\n\n \n b", "it's 's DON'T", "<|endoftext|> <|ENDOFTEXT|>f<|startoftext|>b",
       "İstanbul ΣΑΣ ς", "é é", "\x1c a\x1db", "a　b\xa0c", "日本語 🎉👩‍👩‍👧", "</w>", "12 ５ x1", " lead", "trail ",
       "x" * 3000, "long word " * 4000, "\x00\x7f"]


def _words(n, seed, of=60):
    r = random.Random(seed)
    return [f"w{r.randrange(of)}" for _ in range(n)]


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_token_counts_equal_the_library(docs, word_library):
    rows = list(enumerate(ODD)) + [(3, "a  b"), (None, "no id")]
    got = rows_of(count_tokens(docs(rows, extra=True)), "id", "n_bytes", "n_tokens")
    want = [(i, len((t or "").encode()), len(word_library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == sorted(want, key=lambda t: [(x is not None, x) for x in t])


def test_token_counts_of_an_empty_table(docs):
    assert count_tokens(docs([])).collect() == []


@pytest.fixture(scope="module")
def byte_library():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library_and_comes_back(docs, byte_library):
    rows = list(enumerate(ODD)) + [(None, "no id")]
    df = docs(rows, extra=True)
    got = {r["id"]: r for r in round_trip(df).collect()}
    for i, t in rows:
        ids = byte_library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    coded = encode(df)
    assert {r["id"]: r["text"] for r in decode(coded).collect()} == {i: t or "" for i, t in rows}
    for r in coded.collect():
        raw = (dict(rows)[r["id"]] or "").encode()
        ends = [*r["offsets"][1:], len(raw)]
        assert [byte_library.decode_single_token_bytes(t) for t in r["ids"]] == [raw[a:b] for a, b in zip(r["offsets"], ends)]
        assert all(c == len(raw[:o].decode(errors="ignore")) for o, c in zip(r["offsets"], r["char_offsets"])
                   if o >= len(raw) or raw[o] & 0xC0 != 0x80)


def test_best_fit_takes_the_fullest_bin():
    where, used = best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert where.tolist() == [0, 1, 0, 1, 1] and used.tolist() == [10, 10]


def test_packing_is_gapless_and_whole(docs, word_library):
    texts = [(i, " ".join(_words(n, i))) for i, n in enumerate([3, 50, 400, 2500, 90, 7] * 20)]
    texts += [(500, None), (501, ""), (502, "x " * 9000), (502, "x " * 9000), (None, "no id")]
    got = pack(token_pieces(docs(texts, extra=True)), group=40).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(o + n == p for (o, n), (p, _) in pairwise(b)) and sum(b[-1]) <= 4096
    want = []
    for i, t in texts:
        ids = word_library.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a:a + 4096]
            want.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    have = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got]
    order = lambda t: [(x is not None, x) for x in t]
    assert sorted(have, key=order) == sorted(want, key=order)
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.1 * total / 4096 + 1      # tiny groups; groups of 60,000 pieces fill 99.9 %


@pytest.mark.parametrize("short", [0, 1, 150])
def test_packing_of_mostly_long_pieces_keeps_groups_bounded(spark, monkeypatch, short):
    """Pieces above half a sequence can't share one: what no short piece can fill stays."""
    rounds = []

    def spy(df, *args):
        rounds.append(max([r["count"] for r in df.groupBy("g").count().collect()]))
        return _round(df, *args)
    monkeypatch.setattr("postlens.llm.op9_packing._round", spy)
    r = random.Random(3)
    sizes = [r.choice([2500, r.randrange(2049, 4090)]) for _ in range(4000)] + [r.randrange(1, 180) for _ in range(short)]
    rows = [(i, 0, 0, n, i) for i, n in enumerate(sizes)]
    got = pack(spark.createDataFrame(rows, PIECES), group=100).collect()
    assert max(rounds) <= 200 and len(rounds) <= 5
    bins = {}
    for x in got:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(o + n == p for (o, n), (p, _) in pairwise(b)) and sum(b[-1]) <= 4096
    assert sorted((x["doc_id"], x["length"]) for x in got) == list(enumerate(sizes))
    assert len(bins) == 4000                     # every short piece is in a long one's gap


def test_packing_of_an_empty_table(docs):
    assert pack(token_pieces(docs([]))).collect() == []


def _brute_repeats(rows, window):
    least = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").encode().split()
            for j in range(len(w) - window + 1):
                k = tuple(w[j:j + window])
                least[k] = min(i, least.get(k, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[j:j + window])] < i:
                gone[j:j + window] = [True] * window
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=lambda t: [(x is not None, x) for x in t])


@pytest.mark.parametrize("window", [3, 13])
def test_substring_dedup_equals_brute_force(docs, window, monkeypatch):
    monkeypatch.setattr("postlens.llm.op10_substring_dedup.GROUP", 500)     # many groups
    shared = " ".join(_words(40, 1))
    rows = [(i, " ".join(_words(30, i)) + "\n" + shared * (i % 3 == 0) + " " + " ".join(_words(i % 17, 7))) for i in range(60)]
    rows += [(70, rows[2][1]), (71, rows[2][1]), (71, rows[5][1]), (71, rows[5][1]), (72, None), (73, ""),
             (74, "a " * 3000), (75, "a " * 20), (None, shared)]
    got = rows_of(remove_repeats(docs(rows, extra=True), window=window), "doc_id", "n_words", "n_removed", "kept_sha256")
    # rows of equal id are one document: what either has is the id's
    assert got == _brute_repeats(rows, window)


def test_substring_dedup_of_a_hot_window(docs, monkeypatch):
    """However often a piece meets a window, its group gets one entry."""
    sent = list(_send(0, np.arange(3), ["na " * 5000, "na " * 400, "b " * 90], 13, 4, False))
    assert sum(len(row[2]) // 8 for row in sent) == 2
    monkeypatch.setattr("postlens.llm.op10_substring_dedup._CHUNK", 900)     # several pieces
    rows = [(i, ("na " * (200 + i) if i % 3 else "na ho " * 90) + " ".join(_words(20, i))) for i in range(40)]
    rows += [(5, "na " * 30), (41, "x " * 50), (42, "y " * 50 + "x " * 20)]
    got = rows_of(remove_repeats(docs(rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == _brute_repeats(rows, 13)


@pytest.mark.parametrize("chunk", [300, 1_500_000])
def test_substring_dedup_of_small_pieces_wide_codes_and_spans(docs, monkeypatch, chunk):
    monkeypatch.setattr("postlens.llm.op10_substring_dedup._CHUNK", chunk)
    monkeypatch.setattr("postlens.llm.op10_substring_dedup.NARROW", 64 if chunk > 300 else 0)
    shared = _words(20, 1)
    rows = [(1, " ".join(shared)), (2, " ".join([*_words(3, 2), *shared, "end"])), (3, None), (None, " ".join(shared)), (4, ""),
            (5, " ".join(["x", *shared[:13], "y", *shared[5:19]]))]
    got = rows_of(remove_repeats(docs(rows), with_spans=True, with_text=True), "doc_id", "n_removed", "spans", "kept_text")
    spans = lambda *pairs: [(a, b) for a, b in pairs]
    assert [(r[0], r[1], [tuple(x) for x in r[2]]) for r in got] == [
        (None, 0, spans()), (1, 0, spans()), (2, 20, spans((3, 22))), (3, 0, spans()), (4, 0, spans()), (5, 27, spans((1, 13), (15, 28)))]
    assert [r[3] for r in got][4:] == ["", "x y"]


def test_substring_dedup_of_an_empty_table(docs):
    assert remove_repeats(docs([])).collect() == []


def _shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def _brute_components(rows):
    sets = [(i, _shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets),
                  key=lambda t: [(x is not None, x) for x in t])


def test_near_duplicates_equal_brute_force(docs):
    r = random.Random(4)
    rows, n = [], 0
    for g in range(12):
        base = _words(r.choice([4, 9, 40, 120, 300]), g, 5000)
        for _ in range(r.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                copy[r.randrange(len(copy))] = f"z{r.randrange(10 ** 6)}"
            rows.append((n, " ".join(copy) if n % 5 else " ".join(copy).upper()))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "One"), (n + 3, "one"), (None, rows[0][1]), (3, rows[-1][1]), (3, rows[3][1])]
    got = near_duplicates(docs(rows, extra=True))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == _brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.where("doc_id is not null").collect())


def test_near_duplicates_of_large_open_buckets(docs, monkeypatch):
    """Groups above LOCAL are verified in joins, their buckets above SMALL in rounds of
    centres, and lose no link."""
    monkeypatch.setattr("postlens.llm.op3_near_dedup.LOCAL", 300)
    monkeypatch.setattr("postlens.llm.op3_near_dedup.SMALL", 4)
    monkeypatch.setattr("postlens.llm.op3_near_dedup.CENTRES", 2)
    base = _words(150, 1, 5000)
    r, rows = random.Random(9), []
    for n in range(70):
        copy = list(base)
        for _ in range(r.choice([3, 5, 7, 9])):
            copy[r.randrange(150)] = f"z{r.randrange(10 ** 6)}"
        rows.append((n, " ".join(copy)))
    assert rows_of(near_duplicates(docs(rows)), "doc_id", "n_shingles", "component_id") == _brute_components(rows)


def test_pairs_at_the_threshold_share_a_key():
    """Drawn on the layout of the keys: no more than 1 in 5,000 pairs at 0.75 has none."""
    r = np.random.default_rng(5)
    missed, n = 0, 200_000
    for _ in range(10):
        same = r.random((n // 10, SLOTS)) < 0.75
        missed += int((~same[:, _BAND].all(axis=2).any(axis=1)).sum())
    assert missed <= n / 5_000


def test_near_duplicates_of_an_empty_table(docs):
    assert near_duplicates(docs([])).collect() == []


def test_sketches_give_the_exact_differences():
    texts = ["a b c\nd e f\nd e f", "a b c\nd e f", "", " ".join(_words(900, 3))]
    other = ["a b c\nd e f\nd e f", "x\na b c", "q", " ".join(_words(900, 4))]
    da, ka = elements(texts)
    db, kb = elements(other)
    only_a, only_b = differences(da, ka, db, kb, 4, cells=3)
    for i in range(4):
        a, b = set(ka[da == i].tolist()), set(kb[db == i].tolist())
        assert (only_a[i], only_b[i]) == (len(a - b), len(b - a))


def test_fingerprints_against_the_next_document(docs, monkeypatch):
    monkeypatch.setattr("postlens.llm.op5_iblt.ROWS_PER_RANGE", 4)
    rows = [(i * 3, " ".join(_words(i * 5 % 70, i % 7))) for i in range(40)] + [(200, None), (201, ""), (202, "é" * 9), (203, "é" * 9)]
    got = {r["doc_id"]: r for r in compare_with_next(docs(rows, extra=True)).collect()}
    order = sorted(rows)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (t == edited)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if t == n:
            assert got[i]["near_next"] == 1
    assert got[202]["fingerprint"] == got[203]["fingerprint"]


def test_fingerprints_of_few_rows(docs):
    assert compare_with_next(docs([])).collect() == []
    one = compare_with_next(docs([(1, "ab cd")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest()
    same = compare_with_next(docs([(1, "a"), (1, "b"), (None, "c")])).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in same) == [("1", 1), ("1", 1), ("None", 1)]


def _tongue(i):
    r = random.Random(i)
    ends = ["ing", "tion", "the"] if i % 2 else ["ößt", "ich", "und"]
    return " ".join(r.choice("bcdfgm") + r.choice(ends) for _ in range(25))


def test_language_learns_and_keeps_to_the_split(spark):
    rows = [(i, _tongue(i), "en" if i % 2 else "de") for i in range(300)]
    rows += [(900, None, "en"), (901, "123 !!", "de"), (902, "", None), (None, _tongue(1), None), (903, _tongue(2), ""), (903, _tongue(2), "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in predict(df, fit(df.where(~held_out("doc_id")))).collect()}
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300))
    held = [i for i in range(300) if out[i]["held_out"]]
    assert len(held) > 40 and all(out[i]["lang_pred"] == ("en" if i % 2 else "de") for i in held)
    assert {out[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and out[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_with_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert fit(df) is None
    assert [(r["lang_pred"], r["score"]) for r in predict(df, None).collect()] == [("und", 0.0)]
    assert predict(df.limit(0), None).collect() == []
