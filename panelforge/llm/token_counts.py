"""Token counts with a whole-token shortcut for a lower-casing word-end BPE."""

from __future__ import annotations

import json
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelforge.llm.common import batch_of, decoded, map_rows, per_process, text_rows

#: Cached merges of a worker before the cache starts anew.
CACHE_ENTRIES = 300_000

#: Texts with other characters go through the library whole: up to U+02FF no
#: composition, special casing or disputed white space or letter class exists.
_PLAIN = regex.compile(r"[^\t-\r\x20-\x7e\xa0-˿]")


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pattern_of(path: str) -> str:
    """The split pattern of the tokenizer file's pre-tokenizer."""
    with open(path, encoding="utf-8") as f:
        pre = json.load(f)["pre_tokenizer"]
    return next(p["pattern"]["Regex"] for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split")


def proven_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proven to encode alone as exactly one token.

    The proof runs the library once over the whole vocabulary: a string
    counts if the pattern keeps it as one pre-token and its encoding is one id.
    The size is bounded by the vocabulary file.
    """
    tokenizer, pattern = _load(path), regex.compile(pattern_of(path))
    with open(path, encoding="utf-8") as f:
        suffix = json.load(f)["model"].get("end_of_word_suffix") or ""
    shown = {_letter(b): b for b in range(256)}
    strings = set()
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if token.endswith(suffix):
            try:
                strings.add(bytes(shown[c] for c in token.removesuffix(suffix)).decode("utf-8"))
            except (KeyError, UnicodeDecodeError):
                continue
    whole = sorted(s for s in strings if s and pattern.findall(s) == [s])
    return frozenset(s for s, e in zip(whole, tokenizer.encode_batch(whole, add_special_tokens=False)) if len(e.ids) == 1)


def _letter(byte: int) -> str:
    """How byte-level BPE vocabularies show a byte: printable Latin-1 as itself, others from U+0100 on."""
    hidden = [*range(33), *range(127, 161), 173]
    return chr(256 + hidden.index(byte)) if byte in hidden else chr(byte)


class _Merged(dict):
    """Pre-token to number of tokens: ones for proven strings, else the library's merges, kept."""

    def __init__(self, tokenizer, whole):
        super().__init__(dict.fromkeys(whole, 1))
        self.tokenizer, self.whole = tokenizer, whole

    def __missing__(self, pre_token: str) -> int:
        n = len(self.tokenizer.encode(pre_token, add_special_tokens=False).ids)
        self[pre_token] = n
        return n

    def trim(self) -> None:
        if len(self) > CACHE_ENTRIES + len(self.whole):
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))


class Counter:
    """Counts the tokens of texts as the library does."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer, self.find = _load(path), regex.compile(pattern_of(path)).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merged = _Merged(self.tokenizer, whole)

    def __call__(self, text: str) -> int:
        if _PLAIN.search(text) or any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        n = sum(map(self.merged.__getitem__, self.find(text.lower())))
        self.merged.trim()
        return n


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs`.

    Matching pre-tokens count one through the proven strings; only the rest
    is merged by the library.  Texts with special strings or with characters
    outside the plain range are encoded by the library as a whole.  Null
    texts count as empty (0 bytes, 0 tokens); texts of any length are counted
    whole; null doc_ids and repeated rows stay; an empty table gives none;
    other columns of `docs` are not read.
    """
    whole = proven_whole_tokens(tokenizer_path)

    def make():
        count = per_process("counter:" + tokenizer_path, lambda: Counter(tokenizer_path, whole))

        def run(batch):
            raws = batch.column("raw").to_pylist()
            n = [count(decoded(x)) for x in raws]
            return batch_of(
                doc_id=batch.column("doc_id"),
                n_bytes=pa.array([len(x or b"") for x in raws], pa.int64()),
                n_tokens=pa.array(n, pa.int64()),
                over_limit=pa.array([x > limit for x in n], pa.bool_()),
            )

        return run

    return map_rows(text_rows(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
