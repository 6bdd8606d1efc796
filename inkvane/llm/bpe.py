"""Word-level front end of the word BPE vocabulary, and its merge engine.

The vocabulary file (a tokenizers .json of kind BPE with word ends) declares
NFC, white space folded, lower case, and a split into words; each word is then
merged on its own. Words repeat, so both the counter and the encoder remember
what they found for a word, up to a bound, within one Python worker.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import regex

from .common import distinct_words, short_words, spans_of_words

# Fixed values of the vocabulary file: its white space class (Unicode White_Space) and its word pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters and numbers of Unicode 17, which the library's tables do not hold yet.
NEWER = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LETTER, NUMBER = rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]"
WORDS = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|(?:(?!{LETTER}|{NUMBER})[^{SPACE}])+")
ODD_SPACE = re.compile(r"[\x1c-\x1f]")
# Capitals that this Python's tables may not know (Unicode 16 and 17) and their small letters.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Without one of these bytes a text has none of them.
CAPITAL_LEADS = sorted({chr(c).encode()[:-1] for c in CAPITALS})
WIDE_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words and chunks that a worker remembers, and their bytes together.
REMEMBERED, REMEMBERED_BYTES = 600_000, 1 << 26
#: Slots of the encoder's table of short chunks, a power of two; five eighths of them are used.
SLOTS = 1 << 21


ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def words_in(chunk: str) -> list[str]:
    """The words of a chunk without white space, in lower case."""
    if chunk.isalpha():
        return [chunk]
    return ASCII_WORDS.findall(chunk) if chunk.isascii() and chunk.isprintable() else WORDS.findall(chunk)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class WordVocabulary:
    """What the .json file declares: symbol ranks, special strings, the word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(max(model["vocab"].values()), *self.specials.values()) + 1
        self.vocab = model["vocab"]
        self.special_re = regex.compile("|".join(regex.escape(s) for s in self.specials)) if self.specials else None
        self.bytes = byte_alphabet()

    def segments(self, text: str) -> list[str]:
        """Pieces of text and special strings by turns; special strings have odd places."""
        if not self.specials or "<" not in text:
            return [text]
        return regex.split(f"({self.special_re.pattern})", text)

    @staticmethod
    def normalized(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # character by character there is no final form
            raw = text.encode("utf-8", "surrogatepass")
            if any(x in raw for x in CAPITAL_LEADS):
                text = text.translate(CAPITALS)
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """Chunks between white space; a chunk holds whole words of the pattern."""
        if ODD_SPACE.search(text):  # str.split would also cut here
            return regex.split(rf"[{SPACE}]+", text)
        return text.split()

    def symbols(self, word: str) -> list[str]:
        s = list(word) if word.isascii() and word.isprintable() and " " not in word else [self.bytes[b] for b in word.encode()]
        s[-1] += self.end
        return s


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges, counted without making the merged list.

    The symbols form a linked list; a heap holds adjacent pairs by (rank,
    place). The lowest is popped again and again; a stale entry (one whose pair
    is no longer there) is skipped. The result is the number of symbols less the
    number of merges.
    """
    n = len(symbols)
    if n < 2:
        return n
    text = list(symbols)
    after = [*range(1, n), -1]
    before = [-1, *range(n - 1)]
    rank_of = ranks.get
    heap = []
    for i in range(n - 1):
        r = rank_of((text[i], text[i + 1]))
        if r is not None:
            heap.append((r, i, text[i], text[i + 1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if j < 0 or text[i] is not left and text[i] != left or text[j] != right:
            continue
        text[i] = left + right
        text[j] = ""
        k = after[i] = after[j]
        merges += 1
        if k >= 0:
            before[k] = i
            r = rank_of((text[i], text[k]))
            if r is not None:
                heapq.heappush(heap, (r, i, text[i], text[k]))
        h = before[i]
        if h >= 0:
            r = rank_of((text[h], text[i]))
            if r is not None:
                heapq.heappush(heap, (r, h, text[h], text[i]))
    return n - merges


class TokenCounter:
    """Counts the tokens of whole texts; no identifier is ever made."""

    def __init__(self, path: str):
        self.v = WordVocabulary(path)
        self.words: dict[str, int] = {}
        self.of_chunk: dict[str, int] = {}
        self.held = 0

    def chunk(self, chunk: str) -> int:
        total = 0
        for w in words_in(chunk):
            n = self.words.get(w)
            if n is None:
                n = self.words[w] = merged_length(self.v.symbols(w), self.v.ranks)
                self.held += len(w)
            total += n
        self.held += len(chunk)
        if len(self.of_chunk) >= REMEMBERED or len(self.words) >= REMEMBERED or 4 * self.held > REMEMBERED_BYTES:
            self.words.clear()
            self.of_chunk.clear()
            self.held = 0
        self.of_chunk[chunk] = total
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, known = 0, self.of_chunk
        for k, part in enumerate(self.v.segments(text)):
            if k % 2:
                total += 1
                continue
            for c in self.v.chunks(self.v.normalized(part)):
                n = known.get(c)
                total += self.chunk(c) if n is None else n
        return total


class ChunkPlaces:
    """Places of short chunks: an open-addressed table of three array columns.

    A chunk is its own key: its bytes as two integers, its length in the upper
    byte of the second. So all chunks of a batch are looked up by array
    operations, each is compared whole, and none needs a Python object.
    """

    #: Longer chunks do not fit the two integers.
    BYTES = 15

    def __init__(self):
        self.low, self.high, self.place = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)
        self.room = SLOTS * 5 // 8

    @staticmethod
    def slots(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0xBF58476D1CE4E5B9) + high * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(65 - SLOTS.bit_length())).view(np.int64)

    def get(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The places, -1 where a chunk is not in the table."""
        slot = self.slots(low, high)
        there = self.high[slot]
        hit = (there == high) & (self.low[slot] == low)
        out = np.where(hit, self.place[slot], -1)
        open_ = np.flatnonzero(~hit & (there != 0))
        while len(open_):
            slot[open_] = at = (slot[open_] + 1) & (SLOTS - 1)
            there = self.high[at]
            hit = (there == high[open_]) & (self.low[at] == low[open_])
            out[open_[hit]] = self.place[at[hit]]
            open_ = open_[~hit & (there != 0)]
        return out

    def put(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> None:
        """Remember distinct chunks that are not in the table, as many as there is room for."""
        open_ = np.arange(min(self.room, len(low)))
        self.room -= len(open_)
        slot = self.slots(low, high)
        while len(open_):
            free = open_[self.high[slot[open_]] == 0]
            self.place[slot[free]] = free  # of chunks that want one slot the last written has it
            won = free[self.place[slot[free]] == free]
            at = slot[won]
            self.low[at], self.high[at], self.place[at] = low[won], high[won], place[won]
            lost = np.ones(len(low), bool)
            lost[won] = False
            open_ = open_[lost[open_]]
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)


class TokenEncoder:
    """Identifiers of whole texts by the tokenizers library, word by remembered word.

    A batch's texts are laid out in one buffer; its chunks are found and looked up
    with array operations, so Python touches only chunks that the worker has not
    met (told apart by their bytes) and long ones. Their words go to the library's
    own model together, in space-joined strings.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.v = WordVocabulary(path)
        self.lib = Tokenizer(Tokenizer.from_file(path).model)
        self.lib.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.v.size, bool)
        for s, k in self.v.vocab.items():
            self.ends[k] = s.endswith(self.v.end)
        self.kind = np.dtype("<u2") if self.v.size <= 1 << 16 else np.dtype("<u4")
        # the library's spelling of each byte; words are joined by plain spaces
        self.spelled = np.array([32 if b == 32 else ord(c) for b, c in enumerate(self.v.bytes)], "<u4")
        self.forget()

    def forget(self) -> None:
        """Places in one pool of identifiers, as start * 2**32 + length: of short chunks, of long ones, and of words inside chunks."""
        self.places = ChunkPlaces()
        self.words: dict[str, int] = {}
        self.chunks: dict[bytes, int] = {}
        self.pool = np.empty(1 << 20, self.kind)
        self.used = self.held = 0

    def store(self, ids: np.ndarray) -> int:
        """Append to the pool; where it began."""
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(self.pool), need - len(self.pool)), self.kind)])
        at = self.used
        self.pool[at:need] = ids
        self.used = need
        return at

    def ids_at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the identifiers of all the places in turn, and where each place's end, after a 0."""
        size = place & 0xFFFFFFFF
        ends = np.zeros(len(place) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        at = np.repeat((place >> 32) - ends[:-1], size)
        at += np.arange(len(at))
        return self.pool[at], ends

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Places of what the library makes of the words."""
        places = [np.empty(0, np.int64)]
        for a in range(0, len(words), 1000):
            part = words[a : a + 1000]
            plain = self.spelled[np.frombuffer(b" ".join(part), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.lib.encode_batch_fast([plain], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("a word without an end symbol")
            sizes = np.diff(stops, prepend=0)
            places.append((stops - sizes + self.store(ids) << 32) + sizes)
        return np.concatenate(places)

    def learn_chunks(self, chunks: list[bytes]) -> np.ndarray:
        """Places of chunks; those of several words get the words' identifiers in turn."""
        # chunks of ASCII letters are words
        found = [None if c.isalpha() else words_in(c.decode()) for c in chunks]
        single = [k for k, ws in enumerate(found) if ws is None or len(ws) == 1]
        several = [k for k, ws in enumerate(found) if ws is not None and len(ws) != 1]
        places = np.empty(len(chunks), np.int64)
        places[single] = self.learn([chunks[k] for k in single])
        if several:
            new = list({w for k in several for w in found[k] if w not in self.words})
            raw = [w.encode() for w in new]
            self.held += sum(map(len, raw))
            self.words.update(zip(new, self.learn(raw).tolist(), strict=True))
            ids, ends = self.ids_at(np.array([self.words[w] for k in several for w in found[k]], np.int64))
            stops = ends[np.cumsum([len(found[k]) for k in several])]
            sizes = np.diff(stops, prepend=0)
            places[several] = (stops - sizes + self.store(ids) << 32) + sizes
        return places

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """For each text its identifiers, little-endian, in ``self.kind``."""
        pieces: list[str] = []
        plan: list[list[int]] = []  # of each text: places of its pieces, or -1 - identifier for special strings
        for t in texts:
            mine = []
            for k, s in enumerate(self.v.segments(t or "")):
                if k % 2:
                    mine.append(-1 - self.v.specials[s])
                elif s:
                    mine.append(len(pieces))
                    s = self.v.normalized(s)
                    pieces.append(s if s.isascii() else WIDE_SPACE.sub(" ", s))
            plan.append(mine)
        coded = self.encode_pieces([p.encode() for p in pieces])
        return [b"".join([coded[k] if k >= 0 else np.array([-1 - k], self.kind).tobytes() for k in mine]) for mine in plan]

    def encode_pieces(self, raws: list[bytes]) -> list[bytes]:
        if not raws:
            return []
        if not self.places.room or len(self.words) + len(self.chunks) > REMEMBERED or self.used > REMEMBERED * 16 or self.held > REMEMBERED_BYTES:
            self.forget()
        data = b" ".join(raws) + b" "
        starts, stops = spans_of_words(np.frombuffer(data, np.uint8), part_marks=True)
        low, high = short_words(data, starts, stops)
        place = self.places.get(low, high)
        for k in np.flatnonzero(stops - starts > ChunkPlaces.BYTES).tolist():
            place[k] = self.chunks.get(data[starts[k] : stops[k]], -1)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            first, which = distinct_words(data, starts[missing], stops[missing])
            new = missing[first]
            chunks = [data[a:b] for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]
            learned = self.learn_chunks(chunks)
            place[missing] = learned[which]
            short = stops[new] - starts[new] <= ChunkPlaces.BYTES
            self.places.put(low[new[short]], high[new[short]], learned[short])
            for k in np.flatnonzero(~short).tolist():
                self.chunks[chunks[k]] = int(learned[k])
                self.held += len(chunks[k])
        ids, ends = self.ids_at(place)
        edges = np.cumsum([len(r) + 1 for r in raws])
        cut = [0, *ends[np.searchsorted(starts, edges)].tolist()]
        return [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
