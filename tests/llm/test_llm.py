"""The llm operators against brute force, libraries and exact round trips, with their edge cases."""

import collections
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("inkvane.llm")

import public_tokenizers
from tokenizers import Tokenizer

from inkvane.llm import bpe, chat, decontaminate, flatgraph, hyperminhash, langid, pieces, rans, suffixes, tokencount, tokenfile, toxicity
from inkvane.llm.common import Workspace, components, distinct_words, shingle_set, spans_of_words

VOCAB, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
POOL = "abcdefghijklmnopABC   \t\n.,'’!?#$%0123456789éèñßöÄÜΣσςİıﬁ中文字́̈\x1c\x1f\x85\xa0​ 　😀½²①\x00\x7f_-<|>"
SCHEMA = "doc_id long, text string, id string, text_key int, n int, u string, v string, a int, b int, key string, component_id string, lang string"


def documents(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "u", "v", 3, 4, "k", "c", "en") for i, t in rows], SCHEMA)


def odd_rows():
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    return [(1, None), (2, ""), (3, "  \n "), (4, "one two"), (4, "one two"), (None, "three four five six seven eight nine"), (5, long), (6, long), (7, "x" * 50_000), (8, "Ünï ▁ 中文 \x00 end")]


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


# 1, 5: tokens


def test_tokens_equal_the_library():
    texts = ["", "<|endoftext|>hi<|startoftext|> x", "A<|ENDOFTEXT|>b", "a" * 3000, "ΑΣ ΑΣ.", "don't I'll 's", *random_texts(1500)]
    want = [e.ids for e in Tokenizer.from_file(VOCAB).encode_batch(texts, add_special_tokens=False)]
    counter, encoder = bpe.TokenCounter(VOCAB), bpe.TokenEncoder(VOCAB)
    assert [counter.count(t) for t in texts] == [len(w) for w in want]
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode_batch(texts)] == want


def test_merged_length_is_symbols_less_merges():
    assert bpe.merged_length(list("aaaa"), {("a", "a"): 0}) == 2
    assert bpe.merged_length(list("aaaa"), {("a", "a"): 0, ("aa", "aa"): 1}) == 1
    assert bpe.merged_length(["a"], {}) == 1 and bpe.merged_length([], {}) == 0


def test_count_tokens_edges(spark):
    got = tokencount.count_tokens(documents(spark, odd_rows()), VOCAB).collect()
    assert len(got) == len(odd_rows())
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (1, 2, 3))
    assert [r.over_limit for r in got if r.doc_id == 5] == [True]
    assert tokencount.count_tokens(documents(spark, []), VOCAB).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 150_000])
def test_rans_round_trip(n):
    s = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49_000).astype(np.uint16)
    table = rans.Frequencies(np.bincount(s, minlength=49_408))
    block = rans.encode_block(s, table)
    assert (rans.decode_block(block, table) == s).all()
    if n > rans.LANES * rans.CHECKPOINT:
        assert (rans.decode_block(block, table, 1) == s[rans.LANES * rans.CHECKPOINT :]).all()
        assert (rans.decode_block(block, table, 0, 1) == s[: rans.LANES * rans.CHECKPOINT]).all()
    broken = bytearray(block)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(broken), table)


def test_token_file(spark):
    rows = odd_rows()
    got = tokenfile.token_file(documents(spark, rows), VOCAB, 2).collect()
    ids = [e.ids + [2] for e in Tokenizer.from_file(VOCAB).encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    want, start = [], 0
    for k in order:
        want.append((rows[k][0], start, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())))
        start += len(ids[k])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokenfile.token_file(documents(spark, []), VOCAB, 2).count() == 0


def test_token_file_is_read_by_another_process_from_its_folder_alone(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(random_texts(300, 4))]
    path = str(tmp_path / "tokens")
    tokenfile.write_token_file(documents(spark, rows), VOCAB, 2, path)
    code = f"import sys; sys.path.insert(0, {os.getcwd()!r})\nfrom inkvane.llm.tokenfile import decode_folder\nfor i, ids in decode_folder({path!r}): print(i, *ids.tolist())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.splitlines()
    want = [e.ids + [2] for e in Tokenizer.from_file(VOCAB).encode_batch([t for _, t in rows], add_special_tokens=False)]
    assert sorted(list(map(int, x.split())) for x in out) == sorted([k, *ids] for k, ids in enumerate(want))
    assert {r.doc_id: list(r.ids) for r in tokenfile.decode_documents(spark, path).collect()} == dict(enumerate(want))
    table = rans.Frequencies(tokenfile.read_table(spark, path))
    block = spark.read.parquet(f"{path}/blocks").first()
    d = block.docs[len(block.docs) // 2]
    assert tokenfile.read_span(bytes(block.data), table, d.place, d.n).tolist() == want[d.doc_id]
    with pytest.raises(ValueError):
        rans.decode_block(bytes(block.data), rans.Frequencies(np.ones(5, int)))


def test_distinct_words_go_by_their_bytes(monkeypatch):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("ab") for _ in range(n)).encode() for n in [1, 2, 7, 8, 9, 15, 16, 17, 18, 40] * 60]
    data = b" ".join(words) + b" "
    for _ in range(2):
        starts, stops = spans_of_words(np.frombuffer(data, np.uint8))
        first, which = distinct_words(data, starts, stops)
        assert [data[starts[f] : stops[f]] for f in first[which]] == words and len(first) == len(set(words))
        monkeypatch.setattr("inkvane.llm.common.mixed", lambda x: x & np.uint64(7))  # all keys clash


def test_words_part_from_runs_of_marks():
    words = ["a", "ab.", "a" + "!" * 7, "b" + "." * 8, "c" + ".," * 40, "." * 30, "é!!", "!x", "a.b..", "\x00.", "-" * 12 + ".", "9)", "z" + "?" * 9 + "-" + "?" * 9]
    for data in (" ".join(words).encode() + b" ", b" " + "\n".join(reversed(words)).encode() + b"\t"):
        starts, stops = spans_of_words(np.frombuffer(data, np.uint8), part_marks=True)
        parts = (re.fullmatch(rb"(.*?)([.,!?;:*|$%#&)\"\]]*)", w, re.S).groups() for w in data.split())
        want = [x for w, m in parts for x in ([w, m] if w[-1:].isalnum() and m else [w + m])]
        assert [data[a:b] for a, b in zip(starts, stops, strict=True)] == want
    assert all(len(x) == 0 for x in spans_of_words(np.frombuffer(b"  ", np.uint8), part_marks=True))


def test_chunks_met_before_are_only_looked_up(monkeypatch):
    texts = [*random_texts(400, 5), " ".join(f"w{k} {'long' * 5}{k}, x{k}é" for k in range(3000))]
    handled = []
    monkeypatch.setattr(bpe, "distinct_words", lambda data, starts, stops: handled.append(len(starts)) or distinct_words(data, starts, stops))
    encoder = bpe.TokenEncoder(VOCAB)
    first = encoder.encode_batch(texts)
    handled.clear()
    assert encoder.encode_batch(texts) == first and not sum(handled)


def test_encoder_with_too_little_room_to_remember(monkeypatch):
    texts = [*random_texts(300, 6), "a b\x00 b ab\x00 ab " + " ".join(f"w{k}" for k in range(500)), "abcdefghijklmno abcdefghijklmnop " * 3]
    want = [e.ids for e in Tokenizer.from_file(VOCAB).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bpe, "SLOTS", 64)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    encoder = bpe.TokenEncoder(VOCAB)
    for step in (1, 7, len(texts)):
        got = [b for k in range(0, len(texts), step) for b in encoder.encode_batch(texts[k : k + step])]
        assert [np.frombuffer(b, encoder.kind).tolist() for b in got] == want


def test_table_of_chunks_holds_all_that_clash(monkeypatch):
    monkeypatch.setattr(bpe, "SLOTS", 1024)
    monkeypatch.setattr(bpe.ChunkPlaces, "slots", staticmethod(lambda low, high: np.full(len(low), 1020)))
    table, n = bpe.ChunkPlaces(), 1024 * 5 // 8
    low, high = np.arange(2 * n, dtype=np.uint64) % np.uint64(n), (np.arange(2 * n, dtype=np.uint64) // np.uint64(n) + np.uint64(1)) << np.uint64(56)
    table.put(low[:300], high[:300], np.arange(300))
    table.put(low[300:], high[300:], np.arange(300, 2 * n))
    assert table.room == 0 and table.get(low, high).tolist() == [*range(n), *[-1] * n]


# 3: chat


def test_chat_escapes_are_exact():
    for text in [r"\### Assistant: </turn> ok", "###", "</turn>\n", "\\", "\\\\###", "### User: x</turn>\n", ""]:
        for role in ("user", "assistant", "tool ###: x"):
            segment, a, b = chat.render(role, text)
            assert chat.parse(segment) == (role, text) and chat.unescape(segment[a:b]) == text


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b ###"), (1, 0, "user", "a"), (1, 2, "user", None), (2, 0, None, "z"), (None, 0, "assistant", "q"), (1, 3, "assistant", "c"), (1, 3, "assistant", "c")]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, start string")
    got = {r.conv_id: r for r in chat.chat_digest(spark, df).collect()}
    turns = [("user", "a"), ("assistant", "b ###"), ("user", ""), ("assistant", "c"), ("assistant", "c")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"b ###cc").hexdigest() and got[1].loss_chars == 7 and got[1].n_examples == 3
    assert set(got) == {1, 2, None} and got[2].n_examples == 0
    whole = chat.materialise(chat.format_chat(df), 10_000).filter("conv_id = 1").orderBy("example").collect()
    assert len(whole) == 3 and whole[1].context.startswith(whole[0].context) and chat.unescape(whole[0].target) == "b ###"
    assert chat.chat_digest(spark, df.limit(0)).count() == 0
    examples = {(r.conv_id, r.example): r for r in chat.expand(chat.format_chat(df)).collect()}
    assert len(examples) == 4 and all(len(w.context) == examples[1, w.example].context_chars and w.target == examples[1, w.example].target for w in whole)
    parts = chat.materialise(chat.format_chat(df), 1).filter("conv_id = 1").orderBy("example", "part").collect()
    for w in whole:
        mine = [p for p in parts if p.example == w.example]
        assert "".join(p.context for p in mine) == w.context and [p.target for p in mine if p.target is not None] == [w.target] and len(mine) == examples[1, w.example].context_turns + 1


def test_chat_of_a_long_conversation(spark):
    rows = [(5, k, "assistant" if k % 2 else "user", f"### {k} \\ </turn>" * (3000 if k == 41 else 1)) for k in range(1500)]
    (got,) = chat.chat_digest(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert got.n_turns == 1500 and got.n_examples == 750 and got.loss_sha256 == hashlib.sha256("".join(t for _, k, _, t in rows if k % 2).encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


# 6, 8, 9: duplicates


def variants(seed=3):
    """Bases, exact copies, near copies by a few changed words, and chains of near copies."""
    rnd = random.Random(seed)
    rows, k = [], 0
    for _ in range(12):
        words = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([6, 9, 40, 200]))]
        rows.append(" ".join(words))
        rows.append(rows[-1].upper() + " ")
        for _ in range(4):
            words = list(words)
            words[rnd.randrange(len(words))] = f"x{k}"
            k += 1
            rows.append(" ".join(words))
    return [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, " "), (902, "same"), (903, "same"), (None, "same"), (904, "a b c d e")]


def groups(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rows = variants()
    sets = {i: set(shingle_set(t).tolist()) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = hyperminhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows) and len(links) > 20
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert hyperminhash.near_duplicates(documents(spark, [])).count() == 0


def test_short_near_duplicates_at_80_equal_brute_force(spark):
    rnd, rows = random.Random(8), []
    for n in (5, 6, 7, 8, 9, 10):
        for _ in range(15):
            words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            rows += [words, [*words, "z"], ["y", *words]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    sets = {i: set(shingle_set(t).tolist()) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {len(sets[a]) for a, _ in links} >= {4, 5, 6}
    got = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(documents(spark, rows), percent=80).collect()}
    assert got == groups(sets, links)


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("unit", [(4096, 1 << 20), (16, 1 << 20), (4096, 700)])
def test_dense_group_of_many_components_equals_brute_force(spark, percent, unit):
    """Copies of one text with one to six changed words each: many links, many documents without any."""
    rnd = random.Random(percent)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 220):
        words = list(base)
        for _ in range(rnd.randrange(1, 7)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words[: rnd.choice([150, 150, 130])])))
    sets = {i: set(shingle_set(t).tolist()) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = groups(sets, links)
    assert len(set(want.values())) > 10
    got = hyperminhash.near_duplicates(documents(spark, rows), percent=percent, unit_rows=unit[0], unit_shingles=unit[1]).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_hyperminhash_estimates():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
    rx, ry = hyperminhash.registers(x), hyperminhash.registers(y)
    assert abs(np.mean(rx == ry) - 0.8) < 0.12
    assert len(set(hyperminhash.bands(rx)) & set(hyperminhash.bands(ry))) > 3
    assert not set(hyperminhash.bands(hyperminhash.registers(np.unique(a)))) & set(hyperminhash.bands(hyperminhash.registers(np.unique(b))))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.id: r.component_id for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 199: 199, 200: 199}


def passage_rows(seed=5):
    rnd = random.Random(seed)
    word = lambda: f"q{rnd.randrange(100_000)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(40):
        words = [word() for _ in range(rnd.randrange(0, 150))]
        if i % 2:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = rnd.choice(shared)
        rows.append((i, " ".join(words)))
    return [*rows, (50, rows[3][1]), (51, rows[3][1]), (60, None), (61, ""), (None, rows[3][1]), (5, rows[5][1])]


def brute_spans(rows):
    first, out = {}, {}
    texts = [(i, suffixes.words_of(t)) for i, t in rows if i is not None]
    for i, w in texts:
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            first[key] = min(first.get(key, i), i)
    for i, w in texts:
        for a, b in suffixes.merge([(p, p + 50) for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i]):
            out.setdefault((i, a, b), 1)
    return set(out)


def test_repeated_passages_equal_brute_force(spark):
    rows = passage_rows()
    df = documents(spark, rows)
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffixes.repeated_passages(df).collect()}
    assert got == brute_spans(rows) and len(got) > 8
    left = suffixes.remove_repeats(df)
    assert left.columns == df.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert not brute_spans([(i, t) for i, t in kept if i is not None and i not in (50, 51)]) and not {50, 51} & {i for i, _ in kept}
    assert suffixes.repeated_passages(documents(spark, [])).count() == 0


def test_first_holder_is_the_earliest_of_any_window(spark):
    rnd = random.Random(21)
    words = lambda n: [f"q{rnd.randrange(100_000)}" for _ in range(n)]
    core = words(120)
    texts = {1: words(30) + core[20:75] + words(30), 2: words(9) + core + words(40), 3: words(50) + core + words(3), 4: core[22:110], 5: words(60)}
    got = {(r.doc_id, r.start_word, r.end_word): r.first_id for r in suffixes.repeated_passages(documents(spark, [(i, " ".join(w)) for i, w in texts.items()])).collect()}
    assert got == {(2, 29, 84): 1, (3, 50, 170): 1, (4, 0, 88): 1}


def test_extents_are_the_longest_over_all_rows():
    rnd = random.Random(3)
    rows = sorted((rnd.randrange(3), bytes(rnd.choice([0, 0, 1, 2]) if k % 2 == 0 else 0 for k in range(2 * rnd.randrange(12)))) for _ in range(300))
    schema = pa.schema([("seed", pa.int64()), ("right", pa.binary())])
    batches = [pa.record_batch([pa.array([r[k] for r in rows[a : a + 37]], schema.field(k).type) for k in range(2)], schema=schema) for a in range(0, 300, 37)]
    got = np.concatenate([e for _, e in suffixes.extents(batches, "right")])
    alike = lambda a, b: next((k for k in range(min(len(a), len(b)) // 2) if a[2 * k : 2 * k + 2] != b[2 * k : 2 * k + 2]), min(len(a), len(b)) // 2)
    want = [max(alike(v, w) if s == t else 0 for j, (t, w) in enumerate(rows) if j != i) for i, (s, v) in enumerate(rows)]
    assert got[0] == got[-1] == suffixes.UNLIMITED and got[1:-1].tolist() == want[1:-1]
    assert [len(e) for _, e in suffixes.extents([batches[0].slice(0, 1), batches[0].slice(0, 0)], "right")] == [1]


def brute_occurrences(rows):
    texts = sorted({(i, key, tuple(suffixes.words_of(t))) for i, t, key in rows})
    first, out = {}, set()
    for i, key, w in texts:
        for p in range(len(w) - 49):
            first.setdefault(w[p : p + 50], (i, key, p))
    for i, key, w in texts:
        firsts = [first[w[p : p + 50]] for p in range(len(w) - 49)]
        out |= {(i, key, a, b) for a, b in suffixes.merge([(p, p + 50) for p, f in enumerate(firsts) if f[:2] != (i, key) or p >= f[2] + 50])}
    return out


def test_repeats_inside_documents_equal_brute_force(spark):
    rnd = random.Random(11)
    words = lambda n: [f"q{rnd.randrange(100_000)}" for _ in range(n)]
    p, q, s = words(60), words(90), words(7)
    texts = [(1, p + words(20) + p + words(5) + p[:55]), (2, words(30) + q + words(3)), (2, q + words(40)), (3, s * 30), (4, q[10:80] + q[10:80] + words(9)), (5, ["a"] * 400), (6, words(80)), (7, p[:49] + words(3) + p[:49]), (8, words(9) + s * 12 + words(70) + s * 12)]
    df = documents(spark, [(i, " ".join(w)) for i, w in texts])
    rows = [(r.doc_id, r.text, r.k) for r in df.selectExpr("doc_id", "text", "xxhash64(text) as k").collect()]
    got = {(r.doc_id, r.text_key, r.start_word, r.end_word) for r in suffixes.repeated_passages(df, within=True).collect()}
    assert got == brute_occurrences(rows) and {i for i, *_ in got} == {1, 2, 3, 4, 5, 8}
    assert {(r.doc_id, r.start_word, r.end_word) for r in suffixes.repeated_passages(df).collect()} == brute_spans([(i, t) for i, t, _ in rows])
    left = {r.doc_id: r.text.split() for r in suffixes.remove_repeats(df.filter("doc_id in (1, 5)")).collect()}
    assert left[1] == texts[0][1][:80] + texts[0][1][140:145] and left[5] == ["a"] * 50


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:60] + rng.normal(scale=0.02, size=(60, 16)), base[:1] + rng.normal(scale=0.01, size=(50, 16)), base[:3], base[:3]])
    rows = [(i, [float(np.float32(c)) for c in v], i % 2 if i < 300 else int(i < 360 and (i - 300) % 2)) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, rows[0][1], None), (1004, [None] + rows[0][1][1:], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, component_id string, weight int")
    good = {i: (np.array(v, np.float32).astype(float), label) for i, v, label in rows if i is not None and label is not None and i < 1000}
    unit = {i: v / np.linalg.norm(v) for i, (v, _) in good.items()}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and unit[a] @ unit[b] >= 0.98]
    degree, comp = collections.Counter(k for e in links for k in e), groups([r[0] for r in rows if r[0] is not None], links)
    got = flatgraph.near_vectors(df).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == {i: (degree[i], comp[i]) for i in comp}
    assert flatgraph.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_extreme_lengths_and_string_ids(spark):
    rows = [("a", [1.0, 0.0], 1), ("b", [1e-200, 0.0], 1), ("c", [5e200, 1e199], 1), ("d", [0.0, 1.0], 1), ("e", [0.0, -1e-300], 1), ("f", [1e-310, 0.0], 2)]
    got = flatgraph.near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {"a": (2, "a"), "b": (2, "a"), "c": (2, "a"), "d": (0, "d"), "e": (0, "e"), "f": (0, "f")}


def test_near_vectors_fall_back_to_all_pairs_of_a_label(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 8)), 5, axis=0) + rng.normal(scale=0.02, size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    (graph, recall), (exact, whole) = flatgraph.near_vectors_and_recall(df), flatgraph.near_vectors_and_recall(df, most_shards=1, enough=1.1)
    assert recall >= flatgraph.ENOUGH and whole == 1.0 and sorted(graph.collect()) == sorted(exact.collect())
    assert flatgraph.audit(spark.createDataFrame([(1, 4), (2, 1), (3, 0)], "id long, links long"), spark.createDataFrame([(1, 4)], "id long, links long")) == 0.5


# 2: decontamination


def test_leaks(spark):
    rnd = random.Random(4)
    word = lambda: f"z{rnd.randrange(5000)}"
    items = [[word() for _ in range(n)] for n in (8, 20, 40)]
    noise = lambda n: [word() for _ in range(n)]
    edited = [w if k % 6 else "changed" for k, w in enumerate(items[2])]
    dropped = [w for k, w in enumerate(items[1]) if k % 7]
    cases = {1: (noise(30) + items[0] + noise(30), 0), 2: (edited, 2), 3: (noise(300) + dropped + noise(5), 1), 4: (noise(400), None), 5: (items[2][:10] + noise(50), None)}
    docs = documents(spark, [(i, " ".join(w).capitalize() + ".") for i, (w, _) in cases.items()] + [(6, None), (7, ""), (None, " ".join(items[0])), (1, " ".join(cases[1][0]))])
    bench = spark.createDataFrame([(k, " ".join(w), "e") for k, w in enumerate(items)] + [(9, None, "e"), (10, "", "e")], "item_id long, text string, gram string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(spark, docs, bench).collect()}
    assert got == {(i, k) for i, (_, k) in cases.items() if k is not None}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {4, 5, 6, 7, None}
    assert decontaminate.benchmark_leaks(spark, docs, bench.limit(0)).count() == 0 and decontaminate.benchmark_leaks(spark, docs.limit(0), bench).count() == 0


def test_every_text_of_a_repeated_item_is_sought(spark):
    rnd = random.Random(12)
    a, b = (" ".join(f"z{rnd.randrange(5000)}" for _ in range(20)) for _ in range(2))
    bench = spark.createDataFrame([(7, a), (7, b), (7, b), (8, a)], "item_id long, text string")
    docs = documents(spark, [(1, f"x y {a} z"), (2, f"{b} x"), (3, f"{a} {b}")])
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.benchmark_leaks(spark, docs, bench).collect()}
    assert got == {(1, 7): 1.0, (1, 8): 1.0, (2, 7): 1.0, (3, 7): 1.0, (3, 8): 1.0}


@pytest.mark.parametrize("few", [4_000_000, 0])
def test_leaks_equal_brute_force(spark, monkeypatch, few):
    """All pairs aligned over whole texts; copies with words changed, dropped, added and swapped."""
    monkeypatch.setattr(decontaminate, "FILTER_GRAMS", few)
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(9 if rnd.random() < 0.2 else 2000)}"
    items = [[word() for _ in range(rnd.choice([2, 5, 12, 30]))] for _ in range(25)]
    docs = []
    for i in range(120):
        words = [word() for _ in range(rnd.randrange(0, 120))]
        if i % 2:
            copy = [w for w in rnd.choice(items)]
            for _ in range(rnd.randrange(0, 1 + len(copy) // 4)):
                k = rnd.randrange(len(copy))
                copy[k : k + 1] = rnd.choice([[], [word()], [copy[k], word()]])
                copy = copy or [word()]
            at = rnd.randrange(len(words) + 1)
            words[at:at] = copy
        docs.append((i, " ".join(words)))
    coded = {i: decontaminate.plain_hashes(t) for i, t in docs}
    want = set()
    for k, item in enumerate(items):
        h = decontaminate.plain_hashes(" ".join(item))
        grams = set(decontaminate.gram_hashes(h, min(3, len(h))).tolist())
        # without a common gram there is no seed
        want |= {(i, k) for i, t in coded.items() if decontaminate.align(h, t)[0] >= len(h) and grams & set(decontaminate.gram_hashes(t, min(3, len(h))).tolist())}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(spark, documents(spark, docs), bench).collect()}
    assert len(want) > 50 and got == want


def test_very_long_texts_and_dense_hits(spark):
    """A text that repeats an item thousands of times, and items that share their grams."""
    item = "alpha beta gamma delta epsilon zeta eta theta"
    bench = spark.createDataFrame([(k, item) for k in range(3)] + [(9, "alpha beta gamma")], "item_id long, text string")
    docs = documents(spark, [(1, f"{item} " * 5000), (2, "nothing here"), (3, "beta gamma delta")])
    got = {(r.doc_id, r.item_id): (r.score, r.start_word) for r in decontaminate.benchmark_leaks(spark, docs, bench).collect()}
    assert got == {(1, 0): (1, 0), (1, 1): (1, 0), (1, 2): (1, 0), (1, 9): (1, 0)}


def test_alignment_equals_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 14)
        h = np.zeros((10, 15), int)
        for i in range(1, 10):
            for j in range(1, 15):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


# 4: toxicity


def test_toxicity_held_out(spark):
    rnd = random.Random(6)
    word = lambda: f"t{rnd.randrange(3000)}"
    bad = ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [word() for _ in range(rnd.randrange(20, 80))]
        for _ in range(rnd.randrange(1, 8) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs = documents(spark, [*rows, (700, None), (701, ""), (None, "vile rotten vile")])
    lab = spark.createDataFrame([(*x, "e") for x in labels] + [(3, None, "e"), (None, 1, "e")], "doc_id long, toxic int, y string")
    model = toxicity.fit(docs, lab)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if i % 2]
    assert np.mean([got[i].toxic == (i % 5 == 0) for i in held]) > 0.97
    assert (np.diff(model.thresholds) > 0).all() and not got[700].toxic and not got[701].toxic and got[None].toxic
    assert got[None].expected_severity > got[700].expected_severity
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert not toxicity.toxicity(spark, docs, lab.limit(0)).filter("toxic").count()
    assert toxicity.toxicity(spark, docs.limit(0), lab).count() == 0


def test_ordinal_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    x, y, p = rng.normal(size=(60, 5)), rng.integers(0, 4, 60), rng.normal(size=8) * 0.3
    rows, cols = np.nonzero(np.ones_like(x))
    for m in (x, toxicity.Sparse(rows, cols, x.ravel(), x.shape)):
        _, g = toxicity.loss_and_gradient(p, m, y, 0.1)
        steps = np.eye(8) * 1e-6
        numeric = [(toxicity.loss_and_gradient(p + e, m, y, 0.1)[0] - toxicity.loss_and_gradient(p - e, m, y, 0.1)[0]) / 2e-6 for e in steps]
        assert np.allclose(g, numeric, atol=1e-6)


def test_toxicity_with_given_grades(spark):
    rnd = random.Random(16)
    rows, labels = [], []
    for i in range(500):
        grade = rnd.choice([0, 0, 1, 2, 3])
        words = [f"t{rnd.randrange(900)}" for _ in range(30)] + ["vile"] * 2 * grade
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(grade > 0), grade))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, grade int")
    docs = documents(spark, [*rows, (900, "vile " * 20_000)])
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, lab.filter("doc_id % 2 = 0"), grade_col="grade")).collect()}
    held = [(got[i].expected_severity, g) for i, _, g in labels if i % 2]
    means = [np.mean([s for s, g in held if g == k]) for k in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5 and got[900].grade == 3


def test_toxicity_of_few_labels(spark):
    rows = [(i, f"a{i} b{i} c{i} " + ("vile" if i < 3 else "fine")) for i in range(30)]
    docs = documents(spark, [*rows, (50, "quite vile"), (51, "quite fine")])
    lab = spark.createDataFrame([(i, int(i < 3)) for i in range(30)], "doc_id long, toxic int")
    assert {r.doc_id for r in toxicity.toxicity(spark, docs, lab).filter("toxic").collect()} == {0, 1, 2, 50}
    one = lab.filter("doc_id = 0 or toxic = 0")
    assert {r.doc_id for r in toxicity.toxicity(spark, docs, one).filter("toxic").collect()} >= {0}


# 7: language


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = langid.language_id(spark, pages, docs).collect()
    assert len(got) == pages.count() and np.mean([r.lang == r.address_lang for r in got]) > 0.97
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "http://a.de/x", "", "x"), (None, "nonsense", "<html lang='fr'>", "x")], "page_id long, url string, html string, host string")
    res = {r.page_id: r for r in langid.language_id(spark, odd, docs).collect()}
    assert res[2].address_lang == "de" and res[None].declared == "fr" and res[1].lang is not None
    assert langid.language_id(spark, odd, docs.limit(0)).filter("lang is not null").count() == 0
    assert langid.language_id(spark, odd.limit(0), docs).count() == 0
    assert langid.main_text("<html><nav>a</nav><article>b<script>c</script></article></html>").split() == ["b"]


def test_languages_of_held_out_texts(spark):
    """Labels the model has not seen; address and declaration say nothing, or something false."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.filter("doc_id % 2 = 1 and size(split(text, ' ')) >= 20 and lang is not null").select("doc_id", "lang", "text").collect()
    pages = [(r.doc_id, f"http://h{r.doc_id % 7}.example.com/x", ("<html lang='xx'>" if r.doc_id % 3 else "<html>") + f"<script>nicht und der</script><p>{r.text}</p>") for r in held]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in langid.language_id(spark, df, docs.filter("doc_id % 2 = 0")).collect()}
    assert len(held) > 300 and np.mean([got[r.doc_id] == r.lang for r in held]) > 0.97


def test_a_page_is_left_out_of_its_own_prior(spark):
    docs = spark.createDataFrame([(1, "aa", "xyzzy plugh"), (2, "bb", "foobar quux")], "doc_id long, lang string, text string")
    pages = spark.createDataFrame([(1, "http://one.net/", "<p>xyzzy plugh</p>"), (2, "http://two.net/", "<p>12</p>"), (3, "http://two.net/", "<p>foobar quux</p>"), (4, "http://two.net/", "<p>foobar quux</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.language_id(spark, pages, docs).collect()}
    assert [got[k].lang for k in (1, 2, 3, 4)] == ["aa", "bb", "bb", "bb"] and got[2].text_lang is None
    # the one page of its host is decided by its text and by the other pages of the suffix, which say bb
    profile = langid.fit_profile(docs)
    ll, k = profile.likelihood("xyzzy plugh"), langid.KAPPA
    total = np.array([1 + 1, 2 + 1]) / 5
    suffix = (np.array([0, 2]) + k * total) / (2 + k)
    want = np.exp(ll) * suffix * given_nothing(1, 2)
    assert abs(got[1].p_lang - want[0] / want.sum()) < 1e-9


def given_nothing(a, b):
    """P(no declaration | l) * P(no hint | l) with add-one smoothing: rows place.. other, none for two languages."""
    n = np.array([a, b])
    return ((n + 1) / (n + 4)) ** 2


def test_unclosed_tags_are_read_in_one_pass():
    for html in ("<script>" * 40_000, "<script " * 200_000, "<!--" * 100_000, "<article>" * 100_000, "<" * 500_000, "<div class='ad'>" * 50_000):
        langid.main_text(html)
        langid._DECLARED.search(html)
    assert langid.main_text("a<!-- b --><style>c</style>d<script>e").split() == ["a", "d", "e"]


# 10: pieces


def test_lattice_equals_plain_viterbi(spark):
    model = pieces.load(PIECES)
    words = ["", "a▁b", "▁", "中文字é", "x\ny\t", "𝜲z", "internationalization", "don't", *{w for t in random_texts(60) for w in t.split(" ")}]
    got = pieces.lattice(Workspace(spark, "t"), spark.createDataFrame([(w,) for w in words], "word string"), model).collect()
    assert len(got) == len(set(words))
    for r in got:
        assert list(r.ids) == model.best_path(pieces.SPACE_MARK + r.word)
        assert model.decode(r.ids) == r.word


def test_pieces_equal_the_library():
    import sentencepiece

    model, library = pieces.load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in ["hello world", "a  b", "a   中 x", "   ", " " * 37 + "中", "internationalization of aaaaaaa", *(t.replace("▁", "") for t in random_texts(800, 9))]:
        ids = [i for w in t.split(" ") for i in model.best_path(pieces.SPACE_MARK + w)] if t else []
        assert model.join_spaces(np.array(ids, "<i4")).tolist() == library.encode(t)


def test_pieces_round_trip(spark):
    rows = [*odd_rows(), *[(100 + k, t) for k, t in enumerate(random_texts(200, 7))]]
    df = documents(spark, rows)
    coded = pieces.encode_pieces(df, PIECES)
    assert all(r.round_trip for r in coded.collect())
    back = sorted(((r.doc_id, r.text) for r in pieces.decode_pieces(coded, PIECES).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in rows), key=str)
    assert pieces.encode_pieces(documents(spark, []), PIECES).count() == 0
