"""An English analyser and the web-search grammar, over token arrays.

Text is lower-cased, cut at whatever is no letter or digit, and stemmed; stopwords leave a gap. Analysis is a Python
program over words, so it is done once, when texts are stored (search.indexed()); matching and ranking are expressions
over the stored arrays. A query is words that must all be there, "quoted phrases", ``or`` between alternatives, and ``-``
before what must not be there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.stemming import stem
from lorekeep.functions.workers import reachable

# English stopwords.
STOP = (
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own s same she so some such t than that the their them then there these they this "
    "those through to too under until up very was we were what when where which while who whom why will with you your"
).split()

def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts])


#: The stem of each token; each distinct word is worked out once a worker. Declared so that it is never repeated in a plan.
stems = _stems.asNondeterministic()


def analysed(text: Column, stemmed: bool = True) -> Column:
    """Stems (or words as they stand) in order, with '' where a stopword stands, so that phrases keep their distances."""
    reachable()
    stop = F.array(*[F.lit(w) for w in STOP])
    kept = F.transform(words(F.coalesce(text, F.lit(""))), lambda t: F.when(F.array_contains(stop, t), F.lit("")).otherwise(t))
    return stems(kept) if stemmed else kept


@dataclass(frozen=True)
class Term:
    stems: tuple[str, ...]  # more than one: a phrase; '' stands for a stopword in it
    wanted: bool


def parse(query: str) -> list[list[Term]]:
    """Alternatives, of which one must hold; each is a list of terms that must all hold. ``or`` binds weaker than the
    words on either side of it; one without words on a side is left out."""
    out: list[list[Term]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)"|(\S+)', query):
        if word.lower() == "or":
            if out[-1]:
                out.append([])
            continue
        wanted = not (minus or (word.startswith("-") and len(word) > 1))
        found = ["" if w in STOP else stem(w) for w in re.findall(r"[^\W_]+", (phrase or word).lower())]
        while found and not found[-1]:
            found.pop()
        while found and not found[0]:
            found.pop(0)
        if found:
            out[-1].append(Term(tuple(found), wanted))
    return [terms for terms in out if terms]


def _has(doc: Column, term: Term) -> Column:
    real = [s for s in term.stems if s]
    hit = F.lit(True)
    for s in dict.fromkeys(real):
        hit = hit & F.array_contains(doc, s)
    if len(term.stems) > 1:  # looked for only where all its words are
        at = F.sequence(F.lit(0), F.greatest(F.size(doc) - len(term.stems), F.lit(0)))
        here = lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(doc, i + k) == s, F.lit(False)) for k, s in enumerate(term.stems) if s])
        hit = F.when(hit, F.exists(at, here)).otherwise(False)
    return hit if term.wanted else ~hit


def matches(doc: Column, query: str) -> Column:
    """Whether the analysed document satisfies the query; a query of stopwords alone matches nothing."""
    out = F.lit(False)
    for terms in parse(query):
        out = out | reduce(lambda a, b: a & b, [_has(doc, t) for t in terms])
    return out


def rank(doc: Column, query: str) -> Column:
    """How often the document has a stem that the query wants, damped by its count of words that are no stopwords; not
    comparable with other engines."""
    wanted = sorted({s for terms in parse(query) for t in terms if t.wanted for s in t.stems if s})
    hits = F.size(F.filter(doc, lambda t: t.isin(*wanted))) if wanted else F.lit(0)
    return F.round(hits / (F.lit(1.0) + F.log(F.lit(1.0) + F.size(F.filter(doc, lambda t: t != "")))), 6)
