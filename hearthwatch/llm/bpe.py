"""BPE by prefix-sharing trie traversal: distinct words go into a trie; walking it depth first, each node gets the last
token of its prefix's encoding, so that what words share at their front is encoded once."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthwatch.llm.base import byte_slices, texts_of

END = "</w>"  # fixed value: the mark of a word's last symbol in the vocabulary file
CHUNKS = 200_000  # encoded words and chunks in each of the two generations that a worker keeps
PAIRS = 500_000  # pairs of tokens whose verdict a worker keeps
CHUNK = re.compile(r"[^ \t-\r]+")
CHUNK_LENGTH = 64  # longer chunks are not kept


class Merges:
    """Vocabulary and merge ranks of a BPE file, with the test that two tokens may stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        self.parts = {a + b: (i, a, b) for (a, b), i in self.ranks.items()}
        if len(self.parts) != len(self.ranks):
            raise ValueError("two merges make the same token")
        self.longest = max((len(t) for t in vocabulary), default=0)
        self.pairs: dict[tuple[str, str], bool] = {}
        # tokens that merges can make; whether they do make one of its own letters is found when it is first met
        self.made: dict[str, bool | None] = dict.fromkeys([*(t for t in vocabulary if len(t.removesuffix(END) or t) == 1), *self.parts])

    def apply(self, symbols: list[str]) -> list[str]:
        """Merge the best-ranked pair, leftmost first, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def whole(self, token: str) -> bool:
        """Whether the letters of a token merge into just this token."""
        body = token.removesuffix(END) or token
        ok = self.made[token] = self.apply([*body[:-1], body[-1] + token[len(body) :]]) == [token]
        return ok

    def beside(self, left: str, right: str) -> bool:
        """Whether the merges leave `left` and `right` as they are, side by side: undoing their merges from the last
        one on, no pair across the border may have a merge that came before what was just undone (or with it, if
        that was on the right, since the leftmost of equal merges comes first)."""
        ok = self.pairs.get((left, right))
        if ok is None:
            key, limit, none = (left, right), 1 << 60, (-1, "", "")
            while True:
                if self.ranks.get((left, right), 1 << 60) < limit:
                    ok = False
                    break
                (l, _, left_end), (r, right_start, _) = self.parts.get(left, none), self.parts.get(right, none)
                if l == r == -1:
                    ok = True
                    break
                if l > r:
                    limit, left = l, left_end
                else:
                    limit, right = r + 1, right_start
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok


def encode_words(words: Iterable[str], merges: Merges) -> dict[str, list[str]]:
    """Tokens of each distinct word, as BPE gives them.

    Sorted words are a trie in depth-first order: the stack holds one state for each symbol of the present path, and
    the next word goes on from the part it shares with the last one. A state is the last token of the prefix. A token
    that ends at a node is that node's state if merges make it and it may stand beside the state of the node where it
    begins; this holds for exactly one token. The last symbol of a word carries the end mark, and so is a node of its
    own. Reading states back from the end gives the encoding.
    """
    made, beside = merges.made, merges.beside
    longest = merges.longest
    out: dict[str, list[str]] = {}
    last, states = "", []

    def state(prefix: str, n: int, end: str) -> str:
        for begin in range(max(0, n - longest), n):
            token = prefix[begin:n] + end
            if token in made and (merges.whole(token) if made[token] is None else made[token]):
                if not begin or beside(states[begin - 1], token):
                    return token
        raise ValueError(f"no token of the vocabulary ends {prefix[:n]!r}")

    for word in sorted(set(words)):
        shared, top = 0, min(len(last), len(word) - 1, len(states))
        while shared < top and word[shared] == last[shared]:
            shared += 1
        del states[shared:]
        for n in range(shared + 1, len(word)):
            states.append(state(word, n, ""))
        tokens, at = [], len(word)
        token = state(word, at, END)
        while True:
            tokens.append(token)
            at -= len(token.removesuffix(END) if at == len(word) and token != END else token)
            if at <= 0:
                break
            token = states[at - 1]
        out[word] = tokens[::-1]
        last = word
    return out


def byte_letters() -> dict[int, int]:
    """Letters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - own))}


class ChunkCodec:
    """Words, and chunks between white space -> (ids joined by spaces, number of ids, decoded text).

    Those that come again are looked up. Two generations are kept: what is used goes to the young one, and when that
    is full it becomes the old one, so that frequent chunks stay and memory has a bound.
    """

    # Letters, digits and marks below U+0300 without superscripts and fractions, and the six separators: nothing to
    # compose, lower() is the library's, and WORDS finds what the file's pattern finds.
    PLAIN = re.compile(r"[\t-\r -~\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u02ff]*")
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    # fixed value: the file's own pattern
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("unk_token") or spec.get("decoder"):
            raise ValueError("made for a BPE file with word ends, no unknown token and no decoder")
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(model["vocab"], model["merges"])
        self.ids = {t: str(i) for t, i in model["vocab"].items()} | {a["content"]: str(a["id"]) for a in spec["added_tokens"]}
        self.special = {a["content"] for a in spec["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.plain = self.PATTERN in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\")
        self.letters = byte_letters()
        self.young: tuple[dict[str, str], dict[str, str]] = ({}, {})  # ids and decoded text by chunk
        self.old: tuple[dict[str, str], dict[str, str]] = ({}, {})

    def _pre_tokens(self, text: str) -> list[str]:
        if self.plain and self.PLAIN.fullmatch(text):
            words = self.WORDS.findall(text.lower())
            return words if text.isascii() else [w.encode().decode("latin-1").translate(self.letters) for w in words]
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _split(self, chunk: str) -> list:
        """Special tokens as strings, anything else as a list of words."""
        parts = self.parts.split(chunk) if self.special and "<|" in chunk else [chunk]
        return [p if p in self.special else self._pre_tokens(p) for p in parts if p]

    def units(self, text: str) -> list[str]:
        """What is looked up: the words of a plain text, or the chunks between white space of any other. A word that is
        taken for a chunk is split into itself, so both kinds live in one table."""
        if self.plain and "<|" not in text and self.PLAIN.fullmatch(text):
            return self.WORDS.findall(text.lower())
        return CHUNK.findall(text)

    def learn(self, chunks: Iterable[str]) -> None:
        """Bring the given distinct chunks into the young generation, with one trie over the words not known yet."""
        split, new = {}, set()
        (young_ids, young_texts), (old_ids, old_texts) = self.young, self.old
        for c in chunks:
            if (known := old_ids.get(c)) is not None:
                young_ids[c], young_texts[c] = known, old_texts[c]
            else:
                split[c] = parts = self._split(c)
                for p in parts:
                    if p.__class__ is list:
                        new.update(p)
        words = encode_words(new, self.merges)
        ids = self.ids
        for c, parts in split.items():
            tokens = [t for p in parts for t in ([t for w in p for t in words[w]] if p.__class__ is list else [p])]
            # without a decoder the library joins the token strings by single spaces
            young_ids[c], young_texts[c] = " ".join([ids[t] for t in tokens]), " ".join(tokens)

    def run(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by spaces, decoded text) of each text."""
        ids, decoded = self.young
        split = [self.units(t) for t in texts]
        self.learn({c for s in split for c in s if c not in ids})
        out = []
        for s in split:
            if not all(map(ids.__getitem__, s)):
                s = [c for c in s if ids[c]]  # a chunk of white space beyond the six separators has no ids
            joined = " ".join(map(ids.__getitem__, s))
            out.append((joined.count(" ") + 1 if joined else 0, joined, " ".join(map(decoded.__getitem__, s))))
        if len(ids) > CHUNKS:
            kept = [c for c in ids if len(c) <= CHUNK_LENGTH]
            self.young, self.old = ({}, {}), ({c: ids[c] for c in kept}, {c: decoded[c] for c in kept})
        return out


_CODECS: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    if path not in _CODECS:
        _CODECS[path] = ChunkCodec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, tokenizer: str, texts: bool = False) -> DataFrame:
    """Encode and decode every text: (doc_id, n_tokens, ids_sha256, decoded_sha256), with `texts` also ids and decoded.

    `tokenizer` is the path of the vocabulary file, the same on every machine. Work stays in the input tasks: a task
    encodes the distinct chunks of a slice of a few MB at a time, so memory does not depend on the corpus. A NULL text
    is empty: no ids, the digest of nothing. Repeated rows and NULL ids keep one row each; an empty table gives none;
    other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in byte_slices(batches):
            got = c.run(texts_of(batch))
            columns = [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([sha(g[1]) for g in got]), pa.array([sha(g[2]) for g in got])]
            if texts:
                columns += [pa.array([[int(i) for i in g[1].split()] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got])]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
