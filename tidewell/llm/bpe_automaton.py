"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merge rules give for
some word. It starts as one state with an arc to itself for each base symbol; a
merge (x, y) -> z then adds one gadget: the state that x leads to is copied
without its arc y, x leads to the copy, and wherever x could be read z can be,
leading where y led from the old state. A state is thus kept as the state it
copies, the arc it lacks and the time it was made, and the arcs of z follow from
those of its left parts; the arcs met are kept in a table as they are met.

Every run of symbols has exactly one accepted path that spells it, and so has each
beginning of it. Encoding is a transition table over symbols: a state stands for
the last token of what is read, and for the tokens that may be half read, each with
the token before it. One look-up a symbol gives the next state, and with it the last
token of the path so far; the path is read off backwards by the tokens' lengths.
States and their rows of the table are made from the automaton and the trie of arc
labels when a word first comes to them. Decoding emits the labels of the path's arcs.

Defined results: a null or empty text has no tokens and the digests of nothing;
repeated rows give repeated rows; ids may be of any type and null; an empty table
gives an empty table; columns other than the id and the text are neither read nor
returned.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import dotted, map_arrow
from tidewell.llm.tokenise import Memo, Splitter, byte_symbols

_LATE = 1 << 60
#: Transitions that a worker holds; then the table is begun anew.
TRANSITIONS = 600_000
_OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Automaton:
    """The automaton of a byte-level merge list.

    vocabulary: token -> id; merges: pairs of tokens by rank; suffix: what the
    last symbol of a word carries. Symbols are numbered: a byte, or 256 plus the
    byte where it ends a word and the suffix is not empty.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix, self.labels = bool(suffix), {}
        spelled: dict[int, tuple[int, ...]] = {}
        for b, c in enumerate(byte_symbols()):
            for symbol, name in ((b, c), (256 + b, c + suffix)) if suffix else ((b, c),):
                if name in vocabulary:
                    spelled[vocabulary[name]] = (symbol,)
        #: Of each state: the state it copies, the arc it lacks, when it was made.
        self.copied, self.lacks, self.made = [-1], [-1], [-1]
        #: Of each token: its state, its left part, when it was made.
        self.state = dict.fromkeys(spelled, 0)
        self.left: dict[int, int] = {}
        self.born = dict.fromkeys(spelled, -1)
        for time, (a, b) in enumerate(merges):
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a + b if not suffix or not a.endswith(suffix) else a.removesuffix(suffix) + b]
            if z in spelled or x not in spelled or y not in spelled:
                raise ValueError(f"merge {time} makes a token twice or uses one that no earlier merge makes")
            self._gadget(x, y, z, time)
            spelled[z] = spelled[x] + spelled[y]
        for token, i in vocabulary.items():
            self.labels[i] = token.encode()
        #: The trie of arc labels: node * 512 + symbol -> node; the token that a node spells.
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, symbols in spelled.items():
            node = 0
            for s in symbols:
                step = self.trie.get(node * 512 + s)
                if step is None:
                    step = self.trie[node * 512 + s] = len(self.token_at)
                    self.token_at.append(-1)
                node = step
            self.token_at[node] = token
        #: Of each token the symbols that it spells; of each node of the trie whether it goes on.
        self.size = {token: len(symbols) for token, symbols in spelled.items()}
        self.goes_on = bytearray(len(self.token_at))
        for key in self.trie:
            self.goes_on[key // 512] = 1
        self.arcs: dict[int, bool] = {}
        self._begin()

    def _gadget(self, x: int, y: int, z: int, time: int) -> None:
        old = self.state[x]
        self.copied.append(old)
        self.lacks.append(y)
        self.made.append(time)
        self.state[z] = self.state[y]  # for x = y the old state, as its arcs still stand
        self.state[x] = len(self.copied) - 1
        self.left[z], self.born[z] = x, time

    @functools.cached_property
    def lacking(self) -> list[dict[int, int]]:
        """Not all states' lists at once: filled for a state when an arc of it is first asked for."""
        return [None] * len(self.copied)  # type: ignore[list-item]

    def _missing(self, state: int) -> dict[int, int]:
        """arc -> when it was first taken away, over the state and those it copies."""
        found = self.lacking[state]
        if found is None:
            found, at = {}, state
            while at > 0:
                found[self.lacks[at]] = self.made[at]  # older copies come later and win
                at = self.copied[at]
            self.lacking[state] = found
        return found

    def allows(self, last: int, token: int) -> bool:
        """Whether an arc `token` leaves the state that `last` leads to."""
        key = last << 32 | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > 4_000_000:
                self.arcs.clear()
            missing, until, t, known = self._missing(self.state[last]), _LATE, token, True
            while known:
                gone = missing.get(t)
                known = gone is None or gone > until
                if t not in self.left:
                    break
                until, t = self.born[t], self.left[t]
            self.arcs[key] = known
        return known

    def _begin(self) -> None:
        """The empty table: state 0 has read nothing."""
        #: state * 512 + symbol -> state; of each state its last token, and (token before, node of the trie) of those half read.
        self.table: dict[int, int] = {}
        self.last, self.open = [-1], [((-1, 0),)]
        self.numbered = {self.open[0]: 0}

    def _transition(self, state: int, symbol: int) -> int:
        """Fill in one place of the table."""
        last, open_ = -1, []
        for before, node in self.open[state]:
            node = self.trie.get(node * 512 + symbol, -1)
            if node < 0:
                continue
            token = self.token_at[node]
            if token >= 0 and last < 0 and (before < 0 or self.allows(before, token)):
                last = token
            if self.goes_on[node]:
                open_.append((before, node))
        if last < 0:
            raise ValueError("the merge list accepts no path for this word")
        key = (*open_, (last, 0))
        found = self.numbered.get(key)
        if found is None:
            found = self.numbered[key] = len(self.last)
            self.last.append(last)
            self.open.append(key)
        self.table[state * 512 + symbol] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-split word. Bytes without a symbol are left out."""
        if not word:
            return []
        symbols = list(word)
        if self.suffix:
            symbols[-1] += 256
        if any(s not in self.trie for s in symbols):
            symbols = [s for s in symbols if s in self.trie]
        if len(self.table) > TRANSITIONS:
            self._begin()
        state, table, last, lasts = 0, self.table, self.last, []
        for s in symbols:
            step = table.get(state * 512 + s)
            state = self._transition(state, s) if step is None else step
            lasts.append(last[state])
        path, at = [], len(symbols)
        while at:
            path.append(lasts[at - 1])
            at -= self.size[path[-1]]
        path.reverse()
        return path

    def decode(self, ids) -> bytes:
        """The labels of the arcs, apart by blanks, as a decoder-less tokenizer gives them."""
        return b" ".join(self.labels[i] for i in ids if i in self.labels)


class Encoder:
    """Whole texts by a tokenizer file's splitting rules and the automaton of its merges."""

    def __init__(self, path: str):
        self.split = Splitter(path)
        model = self.split.rules["model"]
        if model["type"] != "BPE" or self.split.rules["decoder"] is not None or model.get("ignore_merges") or model.get("unk_token"):
            raise ValueError("a BPE file without unknown token and decoder is needed")
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.automaton.labels.update({i: t.encode() for t, i in self.split.special_ids.items()})
        self.of_symbol = {c: b for b, c in enumerate(byte_symbols())}
        self.memo = Memo(lambda word: self._word(word.encode()))

    def _word(self, word: bytes) -> tuple[bytes, bytes]:
        ids = self.automaton.encode(word)
        return np.asarray(ids, "<u4").tobytes(), self.automaton.decode(ids)

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit integers, decoded text in UTF-8)."""
        ids, labels = [], []
        get = self.memo.__getitem__
        for part in self.split.parts(text):
            if part in self.split.special_ids:
                ids.append(np.array([self.split.special_ids[part]], "<u4").tobytes())
                labels.append(part.encode())
                continue
            words = self.split.pieces(part)
            if words is None:
                library = self.split.library
                plain = library.normalizer.normalize_str(part) if library.normalizer else part
                cut = library.pre_tokenizer.pre_tokenize_str(plain)
                found = [self._word(bytes(self.of_symbol[c] for c in w)) for w, _ in cut]
            else:
                found = list(map(get, words))
            ids.extend([x[0] for x in found])
            labels.extend([x[1] for x in found if x[0]])
        return b"".join(ids), b" ".join(labels)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path)


def _digest(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for text in batch.column("text"):
                ids, decoded = enc.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            both = [enc.encode(t.as_py() or "") for t in batch.column("text")]
            ids = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x, _ in both], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([y.decode() for _, y in both], pa.string())], ["doc_id", "ids", "decoded"])

    return run


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(dotted(id_column).alias("doc_id"), dotted(text_column).cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<long>, decoded string) of each document."""
    rows = _rows(docs, id_column, text_column)
    return map_arrow(rows, _ids(tokenizer_path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<long>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text of each document."""
    rows = _rows(docs, id_column, text_column)
    return map_arrow(rows, _digest(tokenizer_path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_OUT}")
