"""BPE encoding and decoding by a tokenization automaton.

``Automaton`` compiles a merge list into a deterministic automaton over tokens
by one gadget per merge.  At first a single state reads every symbol.  The
gadget of the merge (u, v) -> w adds, wherever u and then v can be read, an
arc w that leads where v led, and sends u to a copy of its state without the
arc v (and, if u = v, without w).  After the last merge the automaton reads
exactly the token sequences that merging yields.

All u arcs lead to one state at any time, so a state is kept per token, and a
copy is a reference to the state it was copied from and the time of the copy;
an arc inherits the cuts that its left part had when it was added.  Arc tests
walk these references.

Words are read by a table of character transitions: a state of the table holds
the open (token state, trie node) pairs of the characters read so far, and is
built when first reached.  Exactly one arc of the automaton ends at each
character; following these back from the end of the word gives its tokens.

Decoding emits the label of each arc.

The library and this Python may know Unicode of different years.  The characters
that the two compose, order, lower-case or split differently (``unlike``) are found
once by trying all; texts that hold one are split into words by the library.

Defined results: null text is empty; an empty text has no tokens and decodes
to the empty text; very long texts are read whole.  Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of words kept with their tokens by each Python worker (twice over), and states of its transition table.
CACHED_BYTES, TABLE_STATES = 48 << 20, 150_000
ENTRY_BYTES = 220  # of a kept word beside its text and tokens
#: Symbols are bytes; the last byte of a word has its own.  Two keys of a state are no symbols.
WORD_END, LABEL, OPEN = 256, 512, 513
_NEVER = 1 << 60


def byte_labels() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Automaton:
    """Tokens of words over byte symbols, for a vocabulary whose words end in ``suffix``."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "</w>"):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.left: dict[int, int] = {}  # of a merged token
        self.born: dict[int, int] = {}  # the merge that made it
        self.copied: dict[int, int] = {}  # the token whose state its own was copied from, at that time
        self.cuts: dict[int, dict[int, int]] = {}  # arcs cut from a token's state, and when
        self.dead: set[int] = set()  # tokens that no merge can make
        for time, (u, v) in enumerate(pairs):
            self._gadget(time, vocab[u], vocab[v], vocab[u + v])
        self._trie(vocab, suffix)
        self._reset()

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        if w in self.born:
            raise ValueError("two merges make one token")
        if u in self.dead or v in self.dead or not self.reads(u, v):
            self.dead.add(w)  # the merge can never apply
            return
        self.left[w], self.born[w], self.copied[w] = u, time, v
        cut = self.cuts.setdefault(u, {})
        cut[v] = time
        if u == v:
            cut[w] = time

    def reads(self, last: int, token: int) -> bool:
        """Whether an arc ``token`` leaves the state after ``last``."""
        until = _NEVER
        while True:  # the token, its left part, the left part's left part ...
            state, limit = last, until
            while state is not None:  # the state, the state it was copied from ...
                cut = self.cuts.get(state)
                if cut is not None and cut.get(token, _NEVER) < limit:
                    return False
                limit = min(limit, self.born.get(state, _NEVER))
                state = self.copied.get(state)
            if token not in self.born:
                return True
            until = min(until, self.born[token])
            token = self.left[token]

    def _trie(self, vocab: dict[str, int], suffix: str) -> None:
        code = {c: b for b, c in enumerate(byte_labels())}
        self.next: list[dict[int, int]] = [{}]  # trie node -> symbol -> node
        self.ends: list[int] = [-1]  # trie node -> token
        self.size: dict[int, int] = {}
        for text, token in vocab.items():
            last = text.endswith(suffix) and text != suffix
            body = text[: -len(suffix)] if last else text
            if not body or any(c not in code for c in body):
                continue  # no symbols of ours: a control token
            symbols = [code[c] for c in body]
            if len(symbols) > 1 and token not in self.born:
                continue  # no merge makes it
            if last:
                symbols[-1] += WORD_END
            node = 0
            for s in symbols:
                if s not in self.next[node]:
                    self.next[node][s] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                node = self.next[node][s]
            self.ends[node], self.size[token] = token, len(symbols)

    def _reset(self) -> None:
        # a state: symbol -> state, and under LABEL the arc that ends here, under OPEN its pairs
        self.start: dict = {OPEN: ((None, 0),), LABEL: -1}  # pairs of the token before and the trie node since
        self.known: dict[tuple, dict] = {self.start[OPEN]: self.start}

    def _step(self, state: dict, symbol: int) -> dict:
        live, label = [], -1
        for last, node in state[OPEN]:
            node = self.next[node].get(symbol)
            if node is None:
                continue
            token = self.ends[node]
            if token >= 0 and label < 0 and (last is None or self.reads(last, token)):
                label = token
            if self.next[node]:
                live.append((last, node))
        if label < 0:
            raise ValueError("the vocabulary has no token for a byte")
        live.append((label, 0))
        key = tuple(live)
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = {OPEN: key, LABEL: label}
        state[symbol] = to
        return to

    def word(self, word: str) -> list[int]:
        """The tokens of one pre-split word."""
        symbols = list(word.encode("utf-8", "surrogatepass"))
        symbols[-1] += WORD_END
        if len(self.known) > TABLE_STATES:
            self._reset()
        state, ends = self.start, []
        for s in symbols:
            to = state.get(s)
            if to is None:
                to = self._step(state, s)
                if len(self.known) > 2 * TABLE_STATES:  # within a very long word: go on from a copy of the state reached
                    self._reset()
                    to = self.known[to[OPEN]] = {OPEN: to[OPEN], LABEL: to[LABEL]}
            state = to
            ends.append(state[LABEL])
        tokens, i = [], len(symbols)
        while i:
            token = ends[i - 1]
            tokens.append(token)
            i -= self.size[token]
        return tokens[::-1]


def compose(text: str) -> str:
    """NFC and lower case, letter by letter (no final sigma)."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


def word_pattern(spec: dict) -> str:
    """The file's pattern of words; its engine counts Unicode's White_Space as \\s."""
    return spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")


def unlike(source: str) -> str:
    """The code points that the library may treat otherwise than this Python, as the inside of a character class.

    Those that this Python does not know count as such.  Marks are tried before
    and after a mark of the lowest and one of a high class, composed characters
    by their parts, and every character between a letter and a digit.
    """
    import regex
    import tokenizers

    library = tokenizers.Tokenizer.from_str(source)
    gap, white = "\x00", regex.compile(r"\p{White_Space}+")
    codes = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    known = [c for c in map(chr, codes) if unicodedata.category(c) not in ("Cn", "Co")]
    tries = [(c, f"a{c}1") for c in known]
    for c in known:
        if unicodedata.combining(c):
            tries += [(c, t) for t in (f"a{c}\u0334", f"a\u0334{c}", f"a{c}\u0301", f"a\u0301{c}")]
        parts = unicodedata.decomposition(c)
        if parts and not parts.startswith("<"):
            text = "".join(chr(int(p, 16)) for p in parts.split())
            tries.append((text[-1], text))
    theirs = library.normalizer.normalize_str(gap.join(t for _, t in tries)).split(gap)
    odd = {c for (c, t), n in zip(tries, theirs) if white.sub(" ", compose(t)) != n}
    # which are letters, digits or neither: the borders of the words, block by block
    find = regex.compile(word_pattern(json.loads(source))).findall
    split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(json.loads(source)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)

    def differ(block):
        text = gap.join(block)
        return find(text) != [w for w, _ in split.pre_tokenize_str(text)]

    for at in range(0, len(known), 4096):
        block = theirs[at : min(at + 4096, len(known))]
        if differ(block):
            odd |= {c for c, n in zip(known[at:], block) if differ([n])}
    numbers = sorted({ord(c) for c in odd} | {c for c in codes if unicodedata.category(chr(c)) == "Cn"})
    starts = [c for i, c in enumerate(numbers) if i == 0 or numbers[i - 1] != c - 1]
    ends = [c for i, c in enumerate(numbers) if i + 1 == len(numbers) or numbers[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


def _searches(odd: str):
    """Searches of a text for characters of the class ``odd``: an exact one, and a fast one that also stops at others.

    A class of characters of the basic plane alone is a table look-up a
    character, any other a walk over its ranges: the fast search looks for what is
    not among the plain characters of that plane.
    """
    held = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\U([0-9a-f]{8})-\\U([0-9a-f]{8})", odd)]
    plain, at = "", 0
    for a, b in [*held, (0x10000, 0x10000)]:
        if at < min(a, 0x10000):
            plain += f"\\U{at:08x}-\\U{min(a, 0x10000) - 1:08x}"
        at = b + 1
    return re.compile(f"[{odd}]").search, re.compile(f"[^{plain}]").search


class Tokenizer:
    """Splits, encodes and decodes whole texts for one vocabulary file (its JSON text).

    Understands the files of the kind "words with a word-end mark": control
    tokens are found in the raw text, the rest is composed (NFC), lower-cased
    and split into words by the file's pattern; white space goes.
    """

    def __init__(self, source: str, odd: str | None = None):
        import regex

        spec = json.loads(source)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or not model["end_of_word_suffix"] or spec["decoder"]:
            raise ValueError("the vocabulary file asks for another way of splitting")
        self.control = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find_control = regex.compile("(" + "|".join(map(regex.escape, sorted(self.control, key=len, reverse=True))) + ")") if self.control else None
        self.source = source
        self.find_words = regex.compile(word_pattern(spec)).findall
        self.find_odd, self.may_be_odd = _searches(unlike(source) if odd is None else odd)
        self.automaton = Automaton(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.decode = Decoder(spec).decode
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.held = 0  # bytes of words

    def _text(self, text: str) -> list[str]:
        """The ids of each word of a text without control tokens."""
        if text.isascii():
            words = self.find_words(text.lower())
        elif self.may_be_odd(text) and self.find_odd(text):
            words = self._words_of_library(text)
        else:
            words = self.find_words(compose(text))
        ids = list(map(self.words.get, words))
        if None in ids:
            ids = [self._word(w) if i is None else i for w, i in zip(words, ids)]
        return ids

    def _words_of_library(self, text: str) -> list[str]:
        """The words as the library composes and splits them by its own Unicode tables."""
        if not hasattr(self, "library"):
            import tokenizers

            self.library = tokenizers.Tokenizer.from_str(self.source)
            self.byte = {c: b for b, c in enumerate(byte_labels())}
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte[c] for c in w).decode("utf-8") for w, _ in words]

    def _word(self, word: str) -> str:
        ids = self.words.get(word) or self.older.get(word) or " ".join(map(str, self.automaton.word(word)))
        if len(word) <= 64:
            if self.held >= CACHED_BYTES:  # words not met since the last change go
                self.words, self.older, self.held = {}, self.words, 0
            self.words[word] = ids
            self.held += len(word) + len(ids) + ENTRY_BYTES
        return ids

    def encode(self, text: str | None) -> str:
        """The ids of a whole text, in decimal, joined by one space."""
        text = text or ""
        if self.find_control is None or "<|" not in text:
            return " ".join(self._text(text))
        parts: list[str] = []
        for part in self.find_control.split(text):
            if part in self.control:
                parts.append(str(self.control[part]))
            else:
                parts.extend(self._text(part))
        return " ".join(parts)


class Decoder:
    """The labels of a vocabulary file's tokens: all that decoding needs."""

    def __init__(self, spec: dict):
        control = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = {str(i): t for t, i in (spec["model"]["vocab"] | control).items()}

    def decode(self, ids: str) -> str:
        """The labels of the ids, joined by one space (the file names no decoder)."""
        return " ".join(map(self.label.__getitem__, ids.split(" "))) if ids else ""


def _loaded(shared, part: str = "tokenizer"):
    """The tokenizer (or only the decoder) of a broadcast file, compiled once in each Python worker."""
    held = shared.value
    if part not in held:
        held[part] = Decoder(json.loads(held["source"])) if part == "decoder" else Tokenizer(held["source"], held["odd"])
        gc.collect()
        gc.freeze()  # the compiled tables stay: don't walk them again
    return held[part]


_ODD: dict[str, str] = {}


def share(spark: SparkSession, path: str):
    """Broadcast a vocabulary file (a megabyte or two, whatever the data)."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    if source not in _ODD:  # some seconds: once a session
        _ODD[source] = unlike(source)
    return spark.sparkContext.broadcast({"source": source, "odd": _ODD[source]})


def encode(text: Column, shared) -> Column:
    """struct(n_tokens bigint, ids string): the decimal ids of a text joined by spaces."""

    @F.pandas_udf("n_tokens bigint, ids string")
    def bpe_encode(batch: pd.Series) -> pd.DataFrame:
        ids = [_loaded(shared).encode(t) for t in batch]
        return pd.DataFrame({"n_tokens": [i.count(" ") + 1 if i else 0 for i in ids], "ids": ids})

    return bpe_encode(text)


def decode(ids: Column, shared) -> Column:
    """The text of a string of decimal ids; null ids decode to the empty text."""

    @F.pandas_udf("string")
    def bpe_decode(batch: pd.Series) -> pd.Series:
        return pd.Series([_loaded(shared, "decoder").decode(i or "") for i in batch], dtype=object)

    return bpe_decode(ids)


def digests(text: Column, shared) -> Column:
    """struct(n_tokens bigint, ids_sha256 string, decoded_sha256 string) of a text, in one worker."""

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def bpe_digests(batch: pd.Series) -> pd.DataFrame:
        own, rows = _loaded(shared), []
        for text in batch:
            ids = own.encode(text)
            rows.append((ids.count(" ") + 1 if ids else 0, *(hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in (ids, own.decode(ids)))))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return bpe_digests(text)


def id_array(ids: Column) -> Column:
    """Ids as array<int>."""
    return F.when(F.length(ids) > 0, F.split(ids, " ").cast("array<int>")).otherwise(F.array().cast("array<int>"))
