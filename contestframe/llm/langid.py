"""Language identification of documents and of the spans of mixed-language text.

A word's script, told by code point ranges, narrows its candidates to the languages that use the script. Each
candidate scores the word by its letter trigrams. Viterbi over the words, with a penalty for a switch of
language, labels spans; the document's language is the one with the most letters under its spans.

Learning: `fit` counts trigrams and scripts for each language over at most `per_lang` documents of it, those with
the smallest hash of id and text. The counts form a table of fixed size, `BUCKETS` columns for each language,
the only thing that is collected and sent to the tasks.

Defined results: `und` with score 0 for a text that is null, empty or has no letter, and for every text if
nothing was learned; rows without a language teach nothing; repeated rows get one result each; ties go to the
first language in order; other columns are carried and not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestframe.llm.texts import arrow_map, written

BUCKETS = 1 << 16
PER_LANG = 2000
PENALTY = 16.0  # in nats, for a switch of language
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: First code points of script ranges, in order.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x30000, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS], np.int64)
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_NO = np.array([_NAMES.index(n) for _, n in SCRIPTS], np.int64)
_NEVER = -1e6


@dataclass
class Model:
    """Languages, log probability of each trigram bucket, and which language uses which script."""

    langs: list[str]
    scores: np.ndarray
    scripts: np.ndarray


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words (each between blanks), where each word's begin, and each word's script."""
    points = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 2)
    starts = ends - sizes - 2
    mixed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    within = np.ones(len(mixed), bool)
    for cut in (ends[:-1] - 2, ends[:-1] - 1):  # trigrams over the border of two words
        within[cut[cut < len(mixed)]] = False
    buckets = (mixed >> np.uint64(48)).astype(np.int64)[within]
    scripts = _SCRIPT_NO[np.searchsorted(_STARTS, points[starts + 1].astype(np.int64), "right") - 1]
    return buckets, starts - 2 * np.arange(len(words)), scripts


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by five; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Learns from labelled rows, at most `per_lang` of each language."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"))
    rank = Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h").withColumn("n", F.row_number().over(rank)).where(F.col("n") <= per_lang)
    last = written(chosen.groupBy("lang").agg(F.max("h").alias("last")))  # one row for each language
    sample = rows.join(last, "lang").where("h <= last").select("lang", "text")

    def count(batch: pa.RecordBatch):
        totals: dict[str, np.ndarray] = {}
        for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = WORD.findall(body.lower())
            if words:
                buckets, _, scripts = _grams(words)
                sums = totals.setdefault(name, np.zeros(BUCKETS + len(_NAMES), np.int64))
                sums[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                sums[BUCKETS:] += np.bincount(scripts, minlength=len(_NAMES))
        for name, sums in totals.items():
            places = np.flatnonzero(sums)
            yield {"lang": [name] * len(places), "place": places, "n": sums[places]}

    table = arrow_map(sample, count, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    sums = np.zeros((len(langs), BUCKETS + len(_NAMES)))
    sums[table["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int), table["place"].to_numpy(int)] = table["n"]
    grams, scripts = sums[:, :BUCKETS] + 0.5, sums[:, BUCKETS:]
    scores = np.log(grams / grams.sum(axis=1, keepdims=True)) if langs else grams
    used = scripts >= 0.01 * scripts.sum(axis=1, keepdims=True)
    return Model(langs, scores.T.astype(np.float32).copy(), used.T.copy())


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word in each language; languages that do not use its script are out."""
    buckets, starts, scripts = _grams(words)
    scores = np.add.reduceat(model.scores[buckets].astype(np.float64), starts, axis=0)
    usable = model.scripts[scripts]
    known = usable.any(axis=1)
    scores[~usable] = _NEVER
    scores[~known] = 0.0
    return scores


def _settled(scores: np.ndarray, best: int, penalty: float) -> bool:
    """Whether staying with one language is the best path, told without following all paths.

    A language that stays below `best` by half the penalty at worst, and never gets above it by more than the other
    half, cannot repay a switch: coming from a third language saves no more than that one is above `best`.
    """
    lead = np.cumsum(scores - scores[:, [best]], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros(lead.shape[1]), lead[:-1]]), axis=0)
    above = lead - penalty / 2 + np.maximum(penalty / 2, -low)
    return above.max() <= penalty / 2 and above[-1].max() <= 0


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of every word when each switch costs the penalty."""
    best = int(scores.sum(axis=0).argmax())
    if _settled(scores, best, penalty):
        return np.full(len(scores), best)
    rows = scores.tolist()
    stay = range(scores.shape[1])
    now, back = rows[0], []
    for row in rows[1:]:
        most = max(now)
        top, least = now.index(most), most - penalty
        back.append([k if now[k] >= least else top for k in stay])
        now = [(x if x >= least else least) + y for x, y in zip(now, row, strict=True)]
    path = np.empty(len(rows), np.int64)
    at = now.index(max(now))
    for t in range(len(rows) - 1, -1, -1):
        path[t] = at
        if t:
            at = back[t - 1][at]
    return path


def _label(text: str, words: list[str], scores: np.ndarray, model: Model) -> dict:
    path = viterbi(scores)
    letters = np.bincount(path, weights=np.fromiter(map(len, words), np.int64, len(words)), minlength=len(model.langs))
    turns = np.flatnonzero(np.diff(path)) + 1
    starts = [0]
    if len(turns):
        at = [m.start() for m in WORD.finditer(text)]
        starts += [at[t] for t in turns]
    spans = [{"start": a, "end": b, "lang": model.langs[path[t]]} for a, b, t in zip(starts, [*starts[1:], len(text)], [0, *turns], strict=True)]
    return {"lang_pred": model.langs[int(letters.argmax())], "score": float(letters.max() / letters.sum()), "spans": spans}


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with a struct `language`: lang_pred, score (share of letters) and spans (start, end, lang)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        learned = sent.value
        out = []
        for at in range(0, len(texts), 2048):
            bodies = texts.slice(at, 2048).to_pylist()
            words = [WORD.findall(t.lower()) if t else [] for t in bodies]
            numbers: dict[str, int] = {}
            places = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int64, len(ws)) for ws in words]
            scores = word_scores(list(numbers), learned) if numbers and learned.langs else None
            for t, ws, p in zip(bodies, words, places, strict=True):
                known = scores is not None and len(ws) > 0
                out.append(_label(t, ws, scores[p], learned) if known else {"lang_pred": "und", "score": 0.0, "spans": []})
        return pa.array(out, kind)

    typed = "struct<lang_pred:string,score:double,spans:array<struct<start:bigint,end:bigint,lang:string>>>"
    return docs.withColumn("language", F.arrow_udf(run, typed)(F.col(text)))
