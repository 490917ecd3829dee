"""BPE encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens: its states are "after token t", and the sequences it accepts are exactly the ones
that merging gives. It is built by one gadget per merge, in rank order. The gadget of (u, v) deletes the arc v
of state u, and adds the token uv: an arc wherever u has one, leading to a new state that starts as a copy of
the state after v. States are copied by reference with their birth rank, so a gadget costs O(1) and a transition
is looked up by walking the copies back in time (`Automaton.arc`); results are kept in a table.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np

from .common import chunks, quoted, ship
from .rolling import byte_prefix, mix, spans

#: Distinct space-led pieces a worker remembers; the table is emptied beyond that, so memory stays bounded.
CACHE_PIECES = 400_000
#: Arcs that are kept before the table starts anew.
CACHE_ARCS = 4_000_000
#: Arcs of single steps that an automaton remembers before it starts anew.
CACHE_STATES = 1_500_000
#: Bytes of text whose new words are run through the automaton together.
BATCH_BYTES = 8 << 20
#: Bytes of a word up to which new words run through the automaton together; longer ones run alone.
LONGEST_BATCHED = 40
#: How byte-level vocabularies split text before merging; a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char():
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Tables of the tokenization automaton of one vocabulary file."""

    def __init__(self, vocabulary):
        alphabet = _byte_of_char()
        model = vocabulary["model"]
        self.label = {}
        for word, i in model["vocab"].items():
            self.label[i] = bytes(alphabet[c] for c in word)
        self.id = {label: i for i, label in self.label.items()}
        self.special = {t["content"]: t["id"] for t in vocabulary.get("added_tokens", ())}
        self.longest = max(map(len, self.id), default=1)
        self.left, self.right, self.born, self.deleted, self.table = {}, {}, {}, {}, {}
        self.dead = {i for label, i in self.id.items() if len(label) > 1}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(rank, *(self.id[bytes(alphabet[c] for c in part)] for part in (a, b)))

    def _gadget(self, rank, u, v):
        """Delete the arc v of state u; make the arc and the state of uv, if any text can reach them."""
        if (u, v) not in self.deleted:
            reachable = u not in self.dead and v not in self.dead and self._walk(u, v, rank)
            self.deleted[u, v] = rank
            uv = self.id[self.label[u] + self.label[v]]
            if reachable and uv in self.dead:
                self.dead.discard(uv)
                self.left[uv], self.right[uv], self.born[uv] = u, v, rank

    def _walk(self, s, t, limit):
        """Whether state s had the arc t just before gadget `limit`."""
        deleted, born = self.deleted, self.born
        while True:
            if deleted.get((s, t), limit) < limit:
                return False
            made_s, made_t = born.get(s, -1), born.get(t, -1)
            if made_s == made_t == -1:
                return True
            if made_s > made_t:  # state s began as a copy of the state after its right part
                limit, s = made_s, self.right[s]
            else:  # arc t was laid along the arcs of its left part; an equal merge further left went first
                limit, t = made_t + 1, self.left[t]

    def arc(self, s, t):
        """Whether state s has the arc t in the finished automaton."""
        key = (s, t)
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= CACHE_STATES:
                self.table.clear()
            found = self.table[key] = self._walk(s, t, 1 << 60)
        return found

    def word(self, w):
        """Token ids of one pre-split word: the path through the automaton that spells w.

        Each prefix of w has one accepted path at most, so a position from which no arc leads on is dead
        for good, and the search backs up over each position once.
        """
        n, ids, dead = len(w), self.id, self.dead
        whole = ids.get(w)
        if whole is not None and whole not in dead:
            return [whole]
        path, at, tries, stuck = [], 0, [], set()
        length = min(self.longest, n)
        while at < n:
            step = 0
            for k in range(min(length, n - at), 0, -1):
                t = ids.get(w[at : at + k])
                if t is None or t in dead or at + k in stuck or (path and not self.arc(path[-1], t)):
                    continue
                step = k
                break
            if step:
                tries.append(at)
                path.append(t)
                at += step
                length = self.longest
            else:
                stuck.add(at)
                if not path:
                    raise ValueError("a byte without a token")
                path.pop()
                at = tries.pop()
        return path


class IntTable:
    """An open-addressing map of 64-bit keys to small numbers, looked up for whole arrays at once."""

    def __init__(self, bits=12):
        self.mask, self.n = (1 << bits) - 1, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def get(self, keys):
        """The values of keys; -1 where there is none."""
        keys = keys + np.uint64(1)
        slot = (mix(keys) & np.uint64(self.mask)).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
            slot[open_] = (slot[open_] + 1) & self.mask
        return out

    def put(self, keys, values):
        if 2 * (self.n + len(keys)) > self.mask:
            old = self.keys != 0
            kept = self.keys[old] - np.uint64(1), self.values[old]
            self.__init__(max(12, (4 * (self.n + len(keys))).bit_length()))
            self.put(*kept)
        for key, slot, value in zip((keys + np.uint64(1)).tolist(), (mix(keys + np.uint64(1)) & np.uint64(self.mask)).tolist(), values.tolist()):
            while self.keys[slot] not in (0, key):
                slot = (slot + 1) & self.mask
            self.n += int(self.keys[slot] == 0)
            self.keys[slot], self.values[slot] = key, value


class Encoder:
    """Encodes whole texts as ids (little-endian unsigned 32-bit bytes) and decodes them.

    Words that weren't met yet run through the automaton together: column by column, the state that each prefix
    of each word leads to is looked up in the tables of tokens and arcs.
    """

    def __init__(self, automaton):
        import regex

        self.automaton = automaton
        self.pattern = regex.compile(PATTERN)
        self.loose = regex.compile(r" (?=\s|\Z)|\A ")
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(automaton.special, key=len, reverse=True))) if automaton.special else None
        size = max([*automaton.label, *automaton.special.values()], default=0) + 1
        self.labels = [b""] * size
        for i, label in automaton.label.items():
            self.labels[i] = label
        for s, i in automaton.special.items():
            self.labels[i] = s.encode()
        self.led, self.bare, self.known = {"": b""}, {"": b""}, {}
        self.tokens, self.arcs = IntTable(), IntTable()
        usable = [(label, i) for label, i in automaton.id.items() if i not in automaton.dead and len(label) <= LONGEST_BATCHED]
        ends = np.cumsum([0, *(len(label) for label, _ in usable)])
        pre = byte_prefix(np.frombuffer(b"".join(label for label, _ in usable), np.uint8), 0)
        self.tokens.put(spans(pre, ends[:-1], ends[1:], 0), np.array([i for _, i in usable], np.int32))

    def _arcs(self, states, tokens):
        keys = (states.astype(np.uint64) << np.uint64(32)) | tokens.astype(np.uint64)
        out = self.arcs.get(keys)
        if self.arcs.n > CACHE_ARCS:
            self.arcs = IntTable()
            out = self.arcs.get(keys)
        if (out < 0).any():
            new = np.unique(keys[out < 0])
            walk = self.automaton._walk
            self.arcs.put(new, np.array([walk(k >> 32, k & 0xFFFFFFFF, 1 << 60) for k in new.tolist()], np.int32))
            out = self.arcs.get(keys)
        return out == 1

    def _same_length(self, words, n):
        """The ids of words of n bytes each."""
        m = len(words)
        pre = byte_prefix(np.frombuffer(b"".join(words), np.uint8), 0)
        base = np.arange(m) * n
        state = np.full((n + 1, m), -1, np.int64)  # the last token of each prefix's path; the empty prefix needs none
        start = np.zeros((n + 1, m), np.int64)
        for end in range(1, n + 1):
            left = np.arange(m)
            for begin in range(max(0, end - self.automaton.longest), end):
                if begin:
                    left_ = left[state[begin, left] >= 0]
                else:
                    left_ = left
                token = self.tokens.get(spans(pre, base[left_] + begin, base[left_] + end, 0))
                has = token >= 0
                left_, token = left_[has], token[has]
                if begin and len(left_):
                    good = self._arcs(state[begin, left_], token)
                    left_, token = left_[good], token[good]
                if len(left_):
                    state[end, left_], start[end, left_] = token, begin
                    left = left[state[end, left] < 0]
                    if not len(left):
                        break
        out = []
        at, rows = np.full(m, n), []
        while (at > 0).any():
            rows.append(np.where(at > 0, state[at, np.arange(m)], -1))
            at = start[at, np.arange(m)]
        ids = np.array(rows[::-1], np.int64).T
        for row in ids:
            out.append(row[row >= 0].astype("<u4").tobytes())
        return out

    def _learn(self, words):
        """Run new words through the automaton."""
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        by_length = {}
        for w in words:
            raw = w.encode()
            if len(raw) > LONGEST_BATCHED:
                self.known[w] = np.array(self.automaton.word(raw), "<u4").tobytes()
            else:
                by_length.setdefault(len(raw), []).append((w, raw))
        for n, group in by_length.items():
            for (w, _), ids in zip(group, self._same_length([raw for _, raw in group], n)):
                self.known[w] = ids

    def encode_many(self, texts):
        """The ids of each text."""
        if len(self.led) > CACHE_PIECES:
            self.led, self.bare = {"": b""}, {"": b""}
        plan, led, bare = [], set(), set()
        for text in texts:
            parts = [(text, None)]
            if self.special is not None and self.special.search(text):
                parts, at = [], 0
                for m in self.special.finditer(text):
                    parts += [(text[at : m.start()], None), ("", m[0])]
                    at = m.end()
                parts.append((text[at:], None))
            steps = []
            for plain, special in parts:
                if special is not None:
                    steps.append(("special", special, ()))
                elif self.loose.search(plain):  # a space that doesn't lead a word: find the words over the whole text
                    words = self.pattern.findall(plain)
                    bare.update(words)
                    steps.append(("words", "", words))
                else:
                    first, *rest = plain.split(" ")
                    bare.add(first)
                    led.update(rest)
                    steps.append(("led", plain, ()))  # cut again below: the pieces of all texts would take ten times their bytes
            plan.append(steps)
        new_led = [p for p in led if p not in self.led]
        new_bare = [p for p in bare if p not in self.bare]
        found_led = [self.pattern.findall(" " + p) for p in new_led]
        found_bare = [self.pattern.findall(p) for p in new_bare]
        fresh = set()
        for found in (found_led, found_bare):
            for words in found:
                fresh.update(words)
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        self._learn([w for w in fresh if w not in self.known])
        known = self.known
        for cache, new, found in ((self.led, new_led, found_led), (self.bare, new_bare, found_bare)):
            for p, words in zip(new, found):
                cache[p] = known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words))
        out = []
        for steps in plan:
            ids = []
            for kind, first, rest in steps:
                if kind == "special":
                    ids.append(np.array([self.automaton.special[first]], "<u4").tobytes())
                elif kind == "words":
                    ids += map(self.bare.__getitem__, rest)
                else:
                    first, *rest = first.split(" ")
                    ids.append(self.bare[first])
                    ids += map(self.led.__getitem__, rest)
            out.append(b"".join(ids))
        return out

    def encode(self, text):
        return self.encode_many([text])[0]

    def decode(self, ids):
        """The text that the arcs' labels spell; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def load(path):
    """The automaton of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        return Automaton(json.load(f))


def encode_decode(docs, path, id_col="doc_id", text_col="text", keep_ids=False):
    """Encode and decode every whole text.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids (array<int>). A null text is an
    empty one: no tokens. Repeated rows are each encoded; other columns are left out whatever their names.
    The automaton is compiled once on the driver and broadcast: its size is that of the tokenizer file.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load(path))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches):
        coder = Encoder(shared.value)
        for batch in batches:
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for part, _, _ in chunks(batch, text_col, BATCH_BYTES):
                for ids in coder.encode_many([text or "" for text in part.column(1).to_pylist()]):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                    if keep_ids:
                        all_ids.append(np.frombuffer(ids, "<i4"))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if keep_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, schema)
