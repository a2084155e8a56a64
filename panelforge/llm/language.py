"""Language identification by cross-parsing with suffix automata."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import batch_of, decoded, map_rows, per_process, text_rows

#: Letters of sample text for each language, and documents that give an excerpt each.
SAMPLE_CHARS = 24_000
SAMPLE_DOCS = 400
#: Languages that a fit takes: each has a sample on the driver and an automaton in every worker.
MAX_LANGUAGES = 2_000
#: Bytes of all languages' full transition tables; beyond, transitions are looked up by key instead.
TABLE_BYTES = 1 << 27
#: Characters of a lane. Lanes are parsed side by side and then joined, with the outcome of one parse of the whole text.
LANE = 512
#: Characters parsed at once.
AT_ONCE = 4_000_000

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def normalised(text: str) -> str:
    """Lower case, with every run of other characters than letters as one space."""
    return _OTHER.sub(" ", text.lower()).strip()


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a string, by state; state 0 is the start.

    Exactly the substrings of the string can be read.
    """
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nexts


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """One language's suffix automaton over the characters of its own sample.

    `width` counts them and one more, which stands for all others and never
    matches.  Transitions are a table, or sorted keys where that were too big.
    """

    def __init__(self, sample: str, table: bool):
        self.letters, number = np.unique(_codes(sample), return_inverse=True)
        self.width = len(self.letters) + 1
        nexts = suffix_automaton(number.tolist())
        key = np.array([s * self.width + c for s, to in enumerate(nexts) for c in to], np.int64)
        to = np.array([t for to in nexts for t in to.values()], np.int32)
        if table:
            self.table = np.full(len(nexts) * self.width, -1, np.int32)
            self.table[key] = to
        else:
            self.table, by = None, np.argsort(key)
            self.keys, self.to = np.r_[key[by], np.iinfo(np.int64).max], np.r_[to[by], np.int32(-1)]
        start = self.step(np.zeros(self.width, np.int64), np.arange(self.width))
        self.begin = np.where(start < 0, 0, start).astype(np.int32)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after a symbol; -1 where it can't be read."""
        key = state.astype(np.int64) * self.width + symbol
        if self.table is not None:
            return self.table[key]
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], -1)


class Models:
    """One automaton for each language, each with an alphabet of its own."""

    def __init__(self, samples: dict[str, str], table_bytes: int = TABLE_BYTES):
        self.languages = sorted(samples)
        # Phrases cost the logarithm of their sample: a longer one is not favoured for its length.
        self.costs = np.log2([2.0 + len(samples[x]) for x in self.languages])
        table = 8 * sum(len(x) * (len(set(x)) + 1) for x in samples.values()) <= table_bytes
        self.automata = [Automaton(samples[x], table) for x in self.languages]
        # All characters by number; 0 is any that no sample holds.  Every automaton has its own symbol for each number.
        letters = np.unique(np.concatenate([np.zeros(0, np.uint32), *(a.letters for a in self.automata)]))
        self.number = np.zeros(0x110000, np.int32)
        self.number[letters] = np.arange(1, len(letters) + 1)
        self.symbol = []
        for a in self.automata:
            own = np.full(len(letters) + 1, a.width - 1, np.int32)
            own[self.number[a.letters]] = np.arange(len(a.letters))
            self.symbol.append(own)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases [text, language] of the greedy cross-parsings of normalised texts.

        A phrase is the longest match with the language's sample from where
        the last one ended; a character that matches nowhere is one of its
        own.  All lanes are first parsed as if a phrase began with them.  Then
        each lane that its predecessor reaches inside a phrase is parsed from
        there, up to where a phrase begins in both parses, after which they
        are the same.  That is repeated for lanes whose entry has changed, so
        the counts are those of one parse of the whole text.
        """
        out = np.zeros((len(texts), len(self.languages)))
        numbers = [self.number[_codes(t)] for t in texts]
        owner = np.array([i for i, s in enumerate(numbers) for _ in range(0, len(s), LANE)], np.int64)
        if not len(owner):
            return out
        length = np.array([min(LANE, len(s) - a) for s in numbers for a in range(0, len(s), LANE)])
        lanes = np.zeros((len(owner), LANE), np.int32)
        lanes[np.arange(LANE) < length[:, None]] = np.concatenate(numbers)
        grid = lanes.T
        follows = np.r_[False, owner[1:] == owner[:-1]]
        for j, automaton in enumerate(self.automata):
            symbols = self.symbol[j][grid]
            begins = np.zeros(grid.shape, bool)
            end = self._parse(automaton, symbols, length, begins)
            after = np.cumsum(begins[::-1], axis=0, dtype=np.int32)[::-1]  # phrases that begin here or later in the lane
            count = after[0].astype(np.int64)
            entry, last = np.zeros(len(owner), np.int32), end.copy()
            while True:
                come = np.where(follows, np.r_[np.int32(0), last[:-1]], 0)
                again = np.flatnonzero(come != entry)
                if not len(again):
                    break
                entry = come
                count[again], last[again] = self._rejoin(automaton, symbols, length, begins, after, end, again, come[again])
            out[:, j] = np.bincount(owner, count, len(texts))
        return out

    @staticmethod
    def _parse(automaton: Automaton, symbols: np.ndarray, length: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Marks where phrases begin in lanes that are entered between phrases; returns the states at their ends."""
        order = np.argsort(-length, kind="stable")
        active = np.searchsorted(-length[order], -np.arange(symbols.shape[0]), side="left")
        state = np.zeros(len(length), np.int32)
        for t in range(int(length.max(initial=0))):
            live = order[: active[t]]
            s, c = state[live], symbols[t, live]
            to = automaton.step(s, c)
            failed = to < 0
            begins[t, live] = failed | (s == 0)
            state[live] = np.where(failed, automaton.begin[c], to)
        return state

    @staticmethod
    def _rejoin(automaton, symbols, length, begins, after, end, lanes, state) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in lanes entered in given states, and the states at their ends."""
        count, last = np.zeros(len(lanes), np.int64), end[lanes].copy()
        live = np.arange(len(lanes))
        for t in range(symbols.shape[0]):
            over = length[lanes[live]] <= t
            last[live[over]] = state[over]
            live, state = live[~over], state[~over]
            if not len(live):
                break
            c = symbols[t, lanes[live]]
            to = automaton.step(state, c)
            failed = to < 0
            starts = failed | (state == 0)
            joined = starts & begins[t, lanes[live]]
            count[live] += starts
            count[live[joined]] += after[t, lanes[live[joined]]] - 1
            state = np.where(failed, automaton.begin[c], to)[~joined]
            live = live[~joined]
        last[live] = state
        return count, last


def predict(models: Models, texts: list[str]) -> tuple[list[str], list[float]]:
    """The language that needs the fewest normalised phrases for each text, and its share of all languages' weights.

    Ties go to the first language; `und` with score 0 for texts without a letter.
    """
    plain = [normalised(t) for t in texts]
    names, scores = [], []
    at = 0
    while at < len(plain):
        end, chars = at, 0
        while end < len(plain) and (end == at or chars + len(plain[end]) <= AT_ONCE):
            chars += len(plain[end])
            end += 1
        for text, phrases in zip(plain[at:end], models.phrases(plain[at:end])):
            if not models.languages or not _LETTER.search(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            rate = (phrases.clip(min=1) * models.costs) ** -4.0
            best = int(np.argmax(rate))
            names.append(models.languages[best])
            scores.append(float(rate[best] / rate.sum()))
        at = end
    return names, scores


def sample_of(
    docs: DataFrame, fold: int = 1, folds: int = 3, sample_chars: int = SAMPLE_CHARS, sample_docs: int = SAMPLE_DOCS, max_languages: int = MAX_LANGUAGES
) -> dict[str, str]:
    """Normalised sample text of each language, from rows whose crc32(doc_id) mod `folds` is not `fold`.

    Each of at most `sample_docs` documents of a language, taken by the order
    of a hash, gives one excerpt, from a hashed place of its whole text; the
    excerpts are as long as they must be to fill `sample_chars` characters
    between them, with a margin.  Rows without doc_id, lang or text give none.
    """
    spark = docs.sparkSession
    lang, text, key = F.col("lang").cast("string"), F.col("text").cast("string"), F.col("doc_id").cast("long")
    learned = docs.filter((F.crc32(F.col("doc_id").cast("string")) % folds != fold) & lang.isNotNull() & (F.length(text) > 0))
    found = learned.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not found:
        return {}
    # Some four times the wanted rows of each language pass a hash threshold; only they are shuffled and ranked.
    limits = [(r["lang"], int(min(1.0, 4 * sample_docs / r["n"]) * (1 << 30)), max(60, 3 * sample_chars // (2 * min(r["n"], sample_docs)))) for r in found]
    bounds = F.broadcast(spark.createDataFrame(limits, "lang string, most long, share int"))  # max_languages rows at most
    h = F.xxhash64("doc_id", "text")
    rows = learned.select(lang.alias("lang"), key.alias("doc_id"), text.alias("text")).withColumn("h", h).join(bounds, "lang").filter(F.pmod("h", F.lit(1 << 30)) <= F.col("most"))
    place = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - F.col("share") + 1)).cast("int")
    excerpts = rows.select("lang", "h", "doc_id", F.substring("text", place + 1, F.col("share")).alias("text")).distinct()
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ranked = excerpts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample_docs)
    samples: dict[str, str] = {}
    for r in ranked.orderBy("lang", "k").select("lang", "text").collect():
        samples[r["lang"]] = f"{samples.get(r['lang'], '')} {normalised(r['text'])}".strip()
    return {k: v[:sample_chars] for k, v in samples.items() if v}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score for every row of `docs`, from the whole text alone.

    Null and empty texts and texts without a letter are `und` with score 0;
    texts of any length are parsed as one; null doc_ids and repeated rows
    stay; an empty table gives none; other columns are not read.  Tasks get
    the samples; every Python worker builds the automata once.
    """
    name = "language:" + hashlib.sha256(repr(sorted(samples.items())).encode("utf-8", "surrogatepass")).hexdigest()

    def make():
        models = per_process(name, lambda: Models(samples))

        def run(batch):
            raws = batch.column("raw").to_pylist()
            names, scores = predict(models, [decoded(x) for x in raws])
            return batch_of(doc_id=batch.column("doc_id"), lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()))

        return run

    return map_rows(text_rows(docs), make, "doc_id long, lang_pred string, score double")


def language_ids(docs: DataFrame, fold: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`; a null doc_id is not held out.

    Without a learned language every document is `und`.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    return identify(docs, sample_of(docs, fold, folds)).select("doc_id", out.alias("held_out"), "lang_pred", "score")
