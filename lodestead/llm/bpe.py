"""Byte pair encoding as a streaming transducer with bounded lookahead.

A vocabulary file (JSON of a public tokenizer) is read on the driver, where its
size bounds what is sent to the workers. Texts are normalised, cut into
pre-tokens, and each pre-token runs through the merge list. A pre-token of any
length takes constant memory: it is read in windows, and tokens are emitted as
soon as nothing that follows can change them.

**Sufficient lookahead.** Let the merge list be run over a window and over the
window with more symbols behind it. Going through the rules by rank, the two
runs first differ at the window's end, and the leftmost difference can only move
left when a rule (u, v) is applied in one run and not in the other: then it moves
from inside (or the end) of ``v`` to the start of ``v``. For a later rule to move
it further, its right part must begin where the difference is and have been
touched by it: it is the earlier rule's ``u``, its product ``uv``, or a token
that such a token begins. The longest such chain over the list, weighted by the
lengths of the right parts, bounds how far a change can reach (``lookahead``).
Tokens that end earlier than that before the window's end are final.

Decoding is incremental as well: ids become bytes, and a UTF-8 state machine
holds back an unfinished character only. Vocabularies that declare no decoder
decode to their pieces joined by a blank, as their library does.

Defined results: null text is the empty text; an empty text has no tokens;
repeated rows give repeated results; an empty table gives an empty table. Only
the named columns are read, other columns never clash.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestead.llm.frames import map_batches

#: Pre-tokens up to this many symbols are merged in one go and remembered.
SHORT = 48
#: Symbols that a window takes beyond the lookahead.
STRIDE = 4096
#: Characters that are looked up together.
SLICE = 1 << 22
#: Remembered chunks and pre-tokens per generation; two generations are kept.
REMEMBER = 150_000

# The pre-token pattern that byte-level vocabularies use when their file names none.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, other bytes for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols behind a token's end after which nothing can change it (see the module's text).
    ``length`` gives a token's number of symbols."""
    reach: dict[str, int] = {}
    most = 1
    for left, right in merges:
        far = length(right) + reach.get(right, 0)
        most = max(most, far, length(left))
        product = left + right
        begun = max(far, reach.get(left, 0))
        if begun > reach.get(left, 0):
            reach[left] = far
        if begun > reach.get(product, 0):
            reach[product] = begun
    return most


class Generations:
    """A dictionary of bounded size that keeps what was used lately."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


class Bpe:
    """One vocabulary. ``spec`` is the parsed JSON."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE vocabularies are supported")
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rules = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        mark, end = len(self.end), self.end
        self.lookahead = lookahead(merges, lambda t: len(t) - mark if end and t.endswith(end) and len(t) > mark else len(t))
        letters = byte_letters()
        self.byte = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.end) for c in letters]
        self.pieces = {i: t for t, i in self.vocab.items()}
        added = spec.get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        self.pieces |= {t["id"]: t["content"] for t in added}
        self.numbers = {i: str(i) for i in self.pieces}
        self.find_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        steps = _steps(spec.get("normalizer"), "normalizers")
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        before = _steps(spec.get("pre_tokenizer"), "pretokenizers")
        split = next((s for s in before if s["type"] == "Split"), None)
        #: Whether white space is dropped between pre-tokens (then it also bounds chunks).
        self.drops_blanks = split is not None
        self.pattern = regex.compile(split["pattern"]["Regex"] if split else BYTE_LEVEL_PATTERN)
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.unletter = {c: b for b, c in enumerate(letters)}
        self.forget()
        self._tables = self._symbols = None

    # -- one pre-token -------------------------------------------------------

    def pre_token_ids(self, token: str) -> list[int]:
        """Ids of one pre-token."""
        if len(token) > SHORT:
            return list(self.stream(self.symbols(token)))
        found = self.words.get(token)
        if found is None:
            found = self.words.put(token, self.merge_short(list(self.symbols(token))))
        return found

    def symbols(self, token: str) -> Iterator[int]:
        """First symbols of a pre-token: its bytes, the last with the end mark."""
        held = None
        byte = self.byte
        for at in range(0, len(token), STRIDE):
            for b in token[at : at + STRIDE].encode("utf-8", "surrogatepass"):
                if held is not None:
                    yield byte[held]
                held = b
        if held is not None:
            yield self.last[held]

    def merge_short(self, ids: list[int]) -> list[int]:
        rules = self.rules
        while len(ids) > 1:
            best = None
            for pair in zip(ids, ids[1:]):
                rule = rules.get(pair)
                if rule is not None and (best is None or rule < best):
                    best, chosen = rule, pair
            if best is None:
                break
            out, i, n, made = [], 0, len(ids), best[1]
            left, right = chosen
            while i < n:
                if ids[i] == left and i + 1 < n and ids[i + 1] == right:
                    out.append(made)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def merge_window(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """Tokens of a window and the number of symbols that end before each token's end."""
        n, rules = len(ids), self.rules
        ids = list(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*rules[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rules]
        heapq.heapify(heap)
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j] = made, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rule := rules.get((made, ids[k]))) is not None:
                    heapq.heappush(heap, (*rule, i, made, ids[k]))
            if (h := before[i]) >= 0 and (rule := rules.get((ids[h], made))) is not None:
                heapq.heappush(heap, (*rule, h, ids[h], made))
        kept = [i for i in range(n) if alive[i]]
        return [ids[i] for i in kept], [after[i] for i in kept]

    def stream(self, symbols: Iterable[int], stride: int = STRIDE) -> Iterator[int]:
        """Tokens of one pre-token of any length, emitted once they are stable."""
        source, window, more = iter(symbols), [], True
        while more or window:
            while more and len(window) < self.lookahead + stride:
                symbol = next(source, None)
                if symbol is None:
                    more = False
                else:
                    window.append(symbol)
            tokens, ends = self.merge_window(window)
            if not more:
                yield from tokens
                return
            stable = len(window) - self.lookahead
            used = 0
            for token, end in zip(tokens, ends):
                if end >= stable:
                    break
                yield token
                used = end
            if not used:
                stride *= 2  # one token spans the stride; look further
            window = window[used:]

    # -- texts ---------------------------------------------------------------

    def normalise(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # character by character: a final sigma is like any other
            text = text.replace("Σ", "σ").lower()
        return text

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text cut at special tokens: (is special, part)."""
        at = 0
        if self.find_special is not None:
            for m in self.find_special.finditer(text):
                if m.start() > at:
                    yield False, text[at : m.start()]
                yield True, m[0]
                at = m.end()
        if at < len(text):
            yield False, text[at:]

    def pre_tokens(self, part: str) -> Iterator[str]:
        for m in self.pattern.finditer(part):
            yield m[0]

    def ids(self, text: str) -> Iterator[int]:
        """Ids of a text, emitted as they become stable."""
        for special, part in self.parts(text):
            if special:
                yield self.special[part]
            else:
                for token in self.pre_tokens(self.normalise(part)):
                    yield from self.pre_token_ids(token) if len(token) <= SHORT else self.stream(self.symbols(token))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text, as early as they are complete; ids outside the vocabulary are skipped."""
        if not self.byte_decoder:
            first = True
            for i in ids:
                if (piece := self.pieces.get(i)) is not None:
                    yield piece if first else " " + piece
                    first = False
            return
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        unletter = self.unletter
        for i in ids:
            if (piece := self.pieces.get(i)) is not None:
                data = bytes(unletter[c] for c in piece) if all(c in unletter for c in piece) else piece.encode()
                if out := machine.decode(data):
                    yield out
        if out := machine.decode(b"", True):
            yield out

    # -- many pre-tokens at once ---------------------------------------------

    def merge_many(self, tokens: list[str]) -> list[list[int]]:
        """Ids of many short pre-tokens: in each round every one of them applies its
        first applicable rule, so the rounds are as many as the longest has merges."""
        data = [t.encode("utf-8", "surrogatepass") for t in tokens]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        if self._tables is None:
            self._tables = _rule_tables(self.rules)
            self._symbols = np.array([-1 if i is None else i for i in self.byte]), np.array([-1 if i is None else i for i in self.last])
        raw = np.frombuffer(b"".join(data), np.uint8)
        ids = self._symbols[0][raw]
        ends = np.cumsum(sizes)
        ids[ends - 1] = self._symbols[1][raw[ends - 1]]
        word = np.repeat(np.arange(len(data)), sizes)
        done_ids, done_words = [], []
        while len(ids):
            rank, made = _apply(self._tables, ids[:-1], ids[1:])
            rank = np.append(np.where(word[1:] == word[:-1], rank, _NO_RULE), _NO_RULE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(ids)))
            best = np.repeat(best, lengths)
            over = best == _NO_RULE
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
            chosen = (rank == best) & ~over
            if (chosen[1:] & chosen[:-1]).any():  # a rule (x, x) in a run of x: every other one, from the left
                at = np.flatnonzero(chosen)
                runs = np.flatnonzero(np.append(True, np.diff(at) != 1))
                within = np.arange(len(at)) - np.repeat(at_first := runs, np.diff(np.append(at_first, len(at))))
                chosen[at[within % 2 == 1]] = False
            at = np.flatnonzero(chosen)
            ids[at] = made[at]
            keep = ~over
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        word = np.concatenate(done_words)
        ids = np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        flat, cuts = ids[order].tolist(), np.searchsorted(word[order], np.arange(len(tokens) + 1)).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    # -- digests, chunk by chunk ---------------------------------------------

    def forget(self) -> None:
        """Drop what was remembered of texts; the vocabulary stays."""
        self.words, self.chunks = Generations(REMEMBER), Generations(REMEMBER)

    def learn_chunks(self, chunks: list[str]) -> dict[str, tuple[int, str, str]]:
        """For each chunk (what stands between white space): number of tokens, ids, decoded pieces."""
        cut = [[c] if c.isalpha() else self.pattern.findall(c) for c in chunks]
        unknown = list({t for tokens in cut for t in tokens if t not in self.words.new})
        found = dict(zip(unknown, self.merge_many(unknown))) if unknown else {}
        out, piece, number = {}, self.pieces.__getitem__, self.numbers.__getitem__
        found |= self.words.new
        for chunk, tokens in zip(chunks, cut):
            ids = found[tokens[0]] if len(tokens) == 1 else [i for t in tokens for i in found[t]]
            out[chunk] = len(ids), " ".join(map(number, ids)), " ".join(map(piece, ids))
        if len(self.words.new) < REMEMBER:
            for t in unknown:
                if len(t) <= 4:
                    self.words.new[t] = found[t]
        return out

    def digests(self, texts: Iterable[str]) -> list[tuple[int, str, str]]:
        """For each text: number of tokens, and the hashes of the ids joined by a blank and of the decoded text."""
        if not self.drops_blanks or self.byte_decoder:
            return [self._digest_stream(t) for t in texts]
        states, waiting, size = [], [], 0
        for text in texts:
            states.append(state := _Digest())
            for special, part in self.parts(text):
                if special:
                    waiting.append((state, [part], str(self.special[part])))
                    continue
                for piece in _slices(self.normalise(part)):
                    chunks = piece.split() if not _ODD_BLANKS.search(piece) else [c for c in _BLANK_RUNS.split(piece) if c]
                    waiting.append((state, chunks, None))
                    size += len(piece)
                    if size > SLICE:
                        self._flush(waiting)
                        waiting, size = [], 0
        self._flush(waiting)
        return [s.result() for s in states]

    def _flush(self, waiting: list) -> None:
        distinct = set().union(*(chunks for _, chunks, special in waiting if special is None))
        get, new, known = self.chunks.get, [], {}
        for c in distinct:
            if len(c) > SHORT:
                known[c] = None
            elif (entry := get(c)) is None:
                new.append(c)
            else:
                known[c] = entry
        if new:
            learned = self.learn_chunks(new)
            known |= learned
            for c, entry in learned.items():
                self.chunks.put(c, entry)
        for state, chunks, special in waiting:
            if special is not None:
                state.put(1, special, chunks[0])
                continue
            found = [known[c] for c in chunks]
            if None not in found:
                state.put_all(found)
                continue
            for c, entry in zip(chunks, found):
                if entry is not None:
                    state.put_all([entry])
                else:
                    for ids in _batches(i for t in self.pre_tokens(c) for i in self.stream(self.symbols(t))):
                        state.put(len(ids), " ".join(map(str, ids)), "".join(self.decode(ids)))

    def digest(self, text: str) -> tuple[int, str, str]:
        return self.digests([text])[0]

    def _digest_stream(self, text: str) -> tuple[int, str, str]:
        id_hash, text_hash, count = hashlib.sha256(), hashlib.sha256(), 0

        def counted():
            nonlocal count
            for ids in _batches(self.ids(text)):
                id_hash.update(((" " if count else "") + " ".join(map(str, ids))).encode())
                count += len(ids)
                yield from ids

        for piece in self.decode(counted()):
            text_hash.update(piece.encode("utf-8", "surrogatepass"))
        return count, id_hash.hexdigest(), text_hash.hexdigest()


_ODD_BLANKS = regex.compile("[\x1c-\x1f]")
_BLANK_RUNS = regex.compile(r"\s+")


def _batches(ids: Iterable[int]) -> Iterator[list[int]]:
    out: list[int] = []
    for i in ids:
        out.append(i)
        if len(out) == STRIDE:
            yield out
            out = []
    if out:
        yield out


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about ``SLICE`` characters that end at white space."""
    at, n = 0, len(text)
    while at < n:
        to = min(n, at + SLICE)
        while to < n:
            gap = max(text.rfind(" ", at + 1, to), text.rfind("\n", at + 1, to))
            if gap > 0:
                to = gap
                break
            to = min(n, to + SLICE)
        yield text[at:to]
        at = to


class _Digest:
    def __init__(self):
        self.count, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def put(self, count: int, ids: str, pieces: str) -> None:
        if count:
            gap = " " if self.count else ""
            self.ids.update((gap + ids).encode())
            self.text.update((gap + pieces).encode("utf-8", "surrogatepass"))
            self.count += count

    def put_all(self, found: list[tuple[int, str, str]]) -> None:
        if found:
            counts, ids, pieces = zip(*found)
            if 0 in counts:
                ids, pieces = [i for i in ids if i], [p for p in pieces if p]
            self.put(sum(counts), " ".join(ids), " ".join(pieces))

    def result(self) -> tuple[int, str, str]:
        return self.count, self.ids.hexdigest(), self.text.hexdigest()


_NO_RULE = np.iinfo(np.int64).max
_BITS = 21


def _slot(keys: np.ndarray, salt: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(salt)) >> np.uint64(64 - _BITS)).astype(np.int64)


def _rule_tables(rules: dict) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash tables of the rules: each takes the rules whose slot was free, the next one the others."""
    keys = np.array([(a << 32) | b for a, b in rules], np.int64)
    ranks, made = (np.array(x, np.int64) for x in zip(*rules.values()))
    tables, salt = [], 0x9E3779B97F4A7C15
    while len(keys):
        slot = _slot(keys, salt)
        _, own = np.unique(slot, return_index=True)
        at = np.full(1 << _BITS, -1, np.int32)
        at[slot[own]] = np.arange(len(own))
        tables.append((salt, at, keys[own], ranks[own], made[own]))
        rest = np.setdiff1d(np.arange(len(keys)), own)
        keys, ranks, made = keys[rest], ranks[rest], made[rest]
        salt = (salt * 0xBF58476D1CE4E5B9 + 2) % (1 << 64) | 1
    return tables


def _apply(tables, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair its rule's rank (``_NO_RULE`` if none) and product."""
    keys = (left << 32) | right
    rank, made = np.full(len(keys), _NO_RULE), np.zeros(len(keys), np.int64)
    for salt, at, own, ranks, products in tables:
        entry = at[_slot(keys, salt)]
        hit = np.flatnonzero(entry >= 0)
        entry = entry[hit]
        same = own[entry] == keys[hit]
        hit, entry = hit[same], entry[same]
        rank[hit], made[hit] = ranks[entry], products[entry]
    return rank, made


def _steps(part: dict | None, name: str) -> list[dict]:
    if not part:
        return []
    return part[name] if part["type"] == "Sequence" else [part]


_BUILT: dict[int, Bpe] = {}


def built(text: str) -> Bpe:
    """The vocabulary of this JSON text, made once per process."""
    key = hash(text)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Bpe(json.loads(text))
    return _BUILT[key]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Every row with ``out``, the array of its token ids (replacing a column of that name).
    ``path`` names the vocabulary on the driver; null text gives an empty array."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(path))
    names = [c for c in docs.columns if c != out]
    at = names.index(text)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def work(batches):
        bpe = built(shared.value)
        try:
            for batch in batches:
                ids = [np.fromiter(bpe.ids(t or ""), np.int32) for t in batch.column(at).to_pylist()]
                yield {**{c: batch.column(i) for i, c in enumerate(names)}, out: ids}
        finally:  # a worker outlives its tasks, and what other steps of a pipeline run in it needs the memory
            bpe.forget()

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in names]), work, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Every row with ``out``, the text that its ids stand for (replacing a column of that
    name). Null ids are an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(_read(path))
    names = [c for c in rows.columns if c != out]
    at = names.index(ids)
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField(out, T.StringType(), False)])

    def work(batches):
        bpe = built(shared.value)
        for batch in batches:
            texts = ["".join(bpe.decode(i or [])) for i in batch.column(at).to_pylist()]
            yield {**{c: batch.column(i) for i, c in enumerate(names)}, out: texts}

    return map_batches(rows.select(*[F.col(f"`{c}`") for c in names]), work, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` (ids joined by one blank) and ``decoded_sha256``
    (of the text that the ids decode to), without holding a text's ids."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(path))

    def work(batches):
        bpe = built(shared.value)
        for batch in batches:
            found = bpe.digests(t or "" for t in batch.column(1).to_pylist())
            counts, ids, texts = zip(*found) if found else ((), (), ())
            yield {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": texts}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
