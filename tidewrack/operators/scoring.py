"""Model calls. Classifier and annotator are protocols: anything picklable that works on batches fits.

The defaults need no weights, depend on nothing but their input and give the same result on any
partitioning, so pipelines can be run and tested as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import model_json
from ..functions.text import round4


class Scorer(Protocol):
    """Loaded once in each worker, then called with batches of texts."""

    def load(self) -> None: ...
    def score(self, texts: list[str]) -> np.ndarray: ...


class Tokens(Protocol):
    """A tokenizer as far as prompts and classifiers need one."""

    def split(self, text: str) -> list: ...
    def join(self, tokens: list) -> str: ...


@dataclass
class WordTokens:
    """Words with the white space before them: splitting and joining gives the text back."""

    def split(self, text: str) -> list[str]:
        return re.findall(r"\s*\S+|\s+$", text)

    def join(self, tokens: list[str]) -> str:
        return "".join(tokens)


def token_batch(texts: list[str], tokens: Tokens, max_len: int, pad: object = "") -> tuple[list[list], np.ndarray]:
    """Tokens of each text, cut at ``max_len`` and filled up to the longest of the batch, and the mask of the real ones."""
    rows = [tokens.split(t or "")[:max_len] for t in texts]
    width = max(map(len, rows), default=0)
    mask = np.array([[i < len(r) for i in range(width)] for r in rows], dtype=bool).reshape(len(rows), width)
    return [r + [pad] * (width - len(r)) for r in rows], mask


def digest(text: str) -> int:
    """A number below 2^28 that depends on the text only."""
    return int(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16)


@dataclass
class HashScorer:
    """Deterministic stand-in for a classifier: the digest of at most ``max_len`` tokens as a share; 0.5 for no token."""

    max_len: int = 512
    tokens: Tokens = field(default_factory=WordTokens)

    def load(self) -> None:
        pass

    def score(self, texts: list[str]) -> np.ndarray:
        rows, mask = token_batch(texts, self.tokens, self.max_len)
        said = [" ".join(str(t).strip() for t, m in zip(r, real) if m and str(t).strip()) for r, real in zip(rows, mask)]
        return np.array([digest(s) / (2**28 - 1) if s else 0.5 for s in said], dtype=float)


def score(df: DataFrame, scorer: Scorer, text: str = "text", threshold: float = 0.45, batch: int = 256) -> DataFrame:
    """Adds ``bert_score`` (four places), ``bert_label`` and ``bert_threshold``; null texts count as empty.

    Scores are rounded before they are compared. An iterator UDF loads the model once per worker.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer.load()
        for s in batches:
            texts = s.fillna("").tolist()
            parts = [scorer.score(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.Series(np.concatenate(parts).astype(float) if parts else [], dtype=float)

    return labelled(_apart(df, "_p", run(F.col(text))), "_p", threshold)


def labelled(df: DataFrame, raw: str, threshold: float = 0.45) -> DataFrame:
    """A raw score in the column ``raw`` made the three score columns; a null score has a null label."""
    scored = df.withColumn("bert_score", round4(raw)).drop(raw)
    return scored.withColumns({"bert_label": (F.col("bert_score") >= threshold).cast("int"), "bert_threshold": F.lit(float(threshold))})


def _apart(df: DataFrame, name: str, call: Column) -> DataFrame:
    """The result of a model call as a column that no expression or filter above is merged with: a generator of one row stands between."""
    return df.withColumn(name, F.explode(F.array(call)))


def positives(df: DataFrame, threshold: float = 0.45) -> DataFrame:
    return df.filter(F.col("bert_score") >= threshold)


class Annotator(Protocol):
    def load(self) -> None: ...
    def reply(self, prompts: list[str]) -> list[str]: ...


@dataclass
class EchoAnnotator:
    """Deterministic stand-in for a language model: a reply in JSON that depends on the prompt's words only."""

    def load(self) -> None:
        pass

    def reply(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            h = digest(p)
            title = p.partition("TITLE: ")[2].partition("\n")[0]
            if h % 11 == 0:
                out.append("no answer")
            elif h % 3 == 0:
                out.append(json.dumps({"is_relevant": False, "summary": f"Not relevant: {title[:60]}"}, ensure_ascii=False))
            else:
                meta = {"is_relevant": True, "relevance_score": h % 12, "summary": title[:80], "domains": [{"domain": "Neuroscience"}], "modalities": []}
                out.append("Here it is: " + json.dumps(meta, ensure_ascii=False))
        return out


def plain_chat(system: Column, body: Column) -> Column:
    """The instructions, a blank line, the body."""
    return F.concat(system, F.lit("\n\n"), body)


def prompts(df: DataFrame, name: str = "prompt", system: str = "", template: Callable[[Column, Column], Column] = plain_chat) -> DataFrame:
    """Prompts from the columns of ``featurize.paper_text``; with ``system`` as ``template`` joins the two."""
    joined = lambda c: F.array_join(c, ", ")
    body = F.concat(F.lit("TITLE: "), "title", F.lit("\n\nABSTRACT: "), "abstract", F.lit("\n\nTOPICS: "), joined("topics"), F.lit("\nCONCEPTS: "), joined("concepts"), F.lit("\nKEYWORDS: "), joined("keywords"))
    return df.withColumn(name, template(F.lit(system), body) if system else body)


def fit_prompts(df: DataFrame, budget: int, tokens: Tokens | None = None, overhead: int = 0, prompt: str = "prompt", abstract: str = "abstract") -> DataFrame:
    """Prompts within ``budget`` tokens: the abstract loses exactly what is over, from its end; all else stays.

    ``overhead`` is what the system prompt takes. A prompt that is too long without its abstract keeps none.
    """
    t = tokens or WordTokens()

    @F.pandas_udf("string")
    def cut(prompts_: pd.Series, abstracts: pd.Series) -> pd.Series:
        out = []
        for p, a in zip(prompts_.fillna(""), abstracts.fillna("")):
            over = len(t.split(p)) + overhead - budget
            if over > 0 and a:
                kept = t.split(a)
                p = p.replace(f"ABSTRACT: {a}", f"ABSTRACT: {t.join(kept[: max(0, len(kept) - over)])}", 1)
            out.append(p)
        return pd.Series(out, dtype=object)

    short = _apart(df, "_short", cut(F.col(prompt), F.col(abstract)))
    return short.withColumn(prompt, F.col("_short")).drop("_short")


def annotate(df: DataFrame, annotator: Annotator, prompt: str = "prompt", batch: int = 100) -> DataFrame:
    """Adds ``reply`` and, parsed and repaired outside the UDF, ``ai_metadata`` and ``classification``."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        annotator.load()
        for s in batches:
            texts = s.fillna("").tolist()
            yield pd.Series([r for i in range(0, len(texts), batch) for r in annotator.reply(texts[i : i + batch])], dtype=object)

    out = parse_replies(_apart(df, "reply", run(F.col(prompt))), "reply", "title", "ai_metadata")
    m = F.col("ai_metadata")
    return out.withColumn(
        "classification",
        F.struct(m["is_relevant"].alias("relevant"), m["is_relevant"].cast("int").cast("double").alias("confidence"), m["summary"].alias("reason"), F.lit("model").alias("method")),
    )


def parse_replies(df: DataFrame, reply: str, title: str | None, name: str) -> DataFrame:
    """Adds the repaired reply. The text is parsed once into a column of its own, which all members are taken from."""
    parsed = _apart(df, "_v", model_json.extract_json(reply))
    return parsed.withColumn(name, model_json.normalized(F.col("_v"), title)).drop("_v")


def attach_meta(df: DataFrame) -> DataFrame:
    """The members of ``ai_metadata`` as columns of the record, its summary as ``ai_summary``."""
    names = [f for f in df.schema["ai_metadata"].dataType.names if f != "summary"]
    return df.withColumns({n: F.col(f"ai_metadata.{n}") for n in names} | {"ai_summary": F.col("ai_metadata.summary")})
