"""Information-theoretic sanitisation: personal data, and the terms that give it away.

Base spans are found by pattern: email, ip, card, phone. Each distinct value is a protected
entity. Terms are all words of a document outside its base spans; the corpus tells how strongly
a term reveals an entity. With documents as the unit, a term that shares ``n(t,e)`` documents
with entity ``e`` and occurs in ``n(t)`` of ``N`` documents has the pointwise mutual information
``log(N n(t,e) / (n(t) n(e)))``, and the entity's own information is ``log(N / n(e))``. Their
quotient is the share of the entity that the term discloses; 1 means that the term stands
nowhere else. Terms that share at least ``SUPPORT`` documents with the entity are removed from
``REMOVE`` on and generalised from ``GENERALISE`` on, wherever they stand in a document with it.

All documents are counted. Terms are words in lower case, kept as 64-bit digests. As ``n(t,e)``
is at most ``n(e)``, a share of ``g`` needs ``n(t) <= N (n(e) / N) ** g``. Pairs beyond that are
not formed: entities fall into levels by ``n(e)``, and filters tell each level's terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from labelloom.llm.common import KEY, doc_id, in_filter, keyed, membership_filter, row_key, stored

SUPPORT = 2
GENERALISE = 0.8
REMOVE = 0.95
LEVEL = 8
TERM_BITS = 1 << 25
_PAIR_ROWS = 500_000
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the first digit of a run, so later digits need no trial.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the run of local characters, so long runs cost once."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at) if start < at else None
        if tail:
            yield start, tail.end()
            free = tail.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, value)`` by start, then kind; values in a plain form."""
    text = text or ""
    found = []
    if "@" in text:
        found += [(a, b, 0, text[a:b].lower()) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), 1, m[0]))
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2, digits))
        if "+" in text:
            for m in _PHONE.finditer(text):
                digits = _NO_DIGIT.sub("", m[0])
                if 10 <= len(digits) <= 15:
                    found.append((*m.span(), 3, digits))
    return [(a, b, KINDS[k], v) for a, b, k, v in sorted(found, key=lambda s: (s[0], s[2], s[1]))]


def _digest(value: str) -> int:
    h = xxhash.xxh3_64_intdigest(value.encode())
    return h - (1 << 64) if h >> 63 else h


def words_outside(text: str, spans: list[tuple]) -> list[tuple[str, int, int]]:
    """``(word, start, end)`` of the words in lower case between the spans; a span cuts a word."""
    out = []
    at = 0
    for a, b in [*((s[0], s[1]) for s in spans), (len(text), len(text))]:
        if at < a:
            out += [(m[0].lower(), *m.span()) for m in _WORD.finditer(text, at, a)]
        at = max(at, b)
    return out


def document_terms(text: str, spans: list[tuple]) -> set[str]:
    """All distinct words of a text, and the parts that spans cut off words."""
    found = {w.lower() for w in _WORD.findall(text)}
    if spans:
        found.update(w for w, _, _ in words_outside(text, spans))
    return found


def near_terms(text: str, spans: list[tuple]) -> list[tuple[int, int, int, int]]:
    """``(entity, term, start, end)`` of every word in no span, for each entity of the text."""
    entities = sorted(_entities(spans))
    words = [(_digest(w), a, b) for w, a, b in words_outside(text, spans)] if entities else []
    return [(e, *w) for e in entities for w in words]


def _entities(spans: list[tuple]) -> set[int]:
    return {_digest(f"{kind}:{value}") for _, _, kind, value in spans}


_SPANS = "array<struct<start:int,end:int,kind:string>>"


def find(docs: DataFrame) -> DataFrame:
    """Per document: row key, ``doc_id, base`` spans, the ``entities`` in it."""
    schema = f"_lm_id long, _lm_text long, base {_SPANS}, entities array<long>"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [base_spans(t) for t in batch["text"]]
            out = batch.drop(columns="text")
            out["base"] = [[{"start": a, "end": b, "kind": k} for a, b, k, _ in s] for s in spans]
            out["entities"] = [list(_entities(s)) for s in spans]
            yield out

    found = keyed(docs, "text").mapInPandas(scan, schema)
    return found.select(*KEY, doc_id(), "base", "entities")


class _Digests(dict):
    """Digests of the words seen last; it starts again when they grow many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _PAIR_ROWS:
            self.clear()
        self[word] = own = _digest(word)
        return own


def _repeated(found: DataFrame) -> np.ndarray:
    """A filter of the rows that may stand in the table several times."""
    return membership_filter(found.groupBy(*KEY).count().where("count > 1").select(_row().alias("row")), "row")


def _row():
    return F.xxhash64(*KEY)


def _document_counts(docs: DataFrame, again: np.ndarray) -> DataFrame:
    """``(term, n_term)``: documents that hold each term, summed in each task before the shuffle.

    Repeated rows are one document: rows that the filter names keep their key until the shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(again)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        kept: list[tuple] = []
        seen: set[tuple] = set()

        def out() -> pd.DataFrame:
            rows = [(_digest(w), False, 0, 0, n) for w, n in counts.items()]
            return pd.DataFrame(rows + kept, columns=["term", "again", *KEY, "n"]).astype(
                {"again": bool} | {c: "int64" for c in ("term", *KEY, "n")}
            )

        for batch in batches:
            maybe = in_filter(shared.value, batch["row"].to_numpy()).tolist()
            for own, digest, text, twice in zip(
                batch["_lm_id"].tolist(), batch["_lm_text"].tolist(), batch["text"], maybe, strict=True
            ):
                if twice and (own, digest) in seen:
                    continue
                terms = document_terms(text or "", base_spans(text))
                if twice:
                    seen.add((own, digest))
                    kept += [(_digest(w), True, own, digest, 1) for w in terms]
                else:
                    for word in terms:
                        counts[word] = counts.get(word, 0) + 1
                if len(counts) + len(kept) > _PAIR_ROWS:
                    yield out()
                    counts, kept = {}, []
                if len(seen) > _PAIR_ROWS:
                    seen = set()
        yield out()

    rows = keyed(docs, "text", F.xxhash64(*row_key()).alias("row"))
    parts = rows.mapInPandas(count, "term long, again boolean, _lm_id long, _lm_text long, n long")
    # Dealt by all columns, so that a term of many repeated rows is no hot key.
    parts = parts.groupBy("term", "again", *KEY).agg(F.sum("n").alias("n"))
    return parts.groupBy("term").agg(F.sum(F.when(F.col("again"), F.lit(1)).otherwise(F.col("n"))).alias("n_term"))


def _levels(terms: DataFrame, entities: DataFrame, total: int, support: int, generalise: float) -> list[tuple]:
    """Filters ``(entities, terms)`` per level: entities in at least so many documents, and the
    terms rare enough for the most frequent entity below the next level."""
    top = entities.agg(F.max("n_entity")).first()[0] or 0
    out, least = [], 1
    while least <= top:
        most = min(least * LEVEL, total)
        if least * LEVEL > support:
            own = membership_filter(entities.where(F.col("n_entity") >= max(least, support)), "entity")
            # Without a positive threshold nothing is too frequent.
            bound = total * (most / total) ** generalise * (1 + 1e-6) if generalise > 0 else float(total)
            able = membership_filter(terms.where(F.col("n_term") <= bound), "term", TERM_BITS)
            out.append((own, able))
        least *= LEVEL
    return out


def _lowest(filters: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """The first filter that passes each value, or their number."""
    out = np.full(len(values), len(filters))
    for level in reversed(range(len(filters))):
        out[in_filter(filters[level], values)] = level
    return out


def _pairs(docs: DataFrame, again: np.ndarray, levels: list[tuple], support: int) -> DataFrame:
    """``(entity, term, n_both)`` of pairs that share ``support`` documents and can be disclosing.

    Rows are summed in each task. Repeated rows are one document, so those that may be repeated
    (told by a filter) keep their key.
    """
    shared = docs.sparkSession.sparkContext.broadcast((levels, again))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels, again = shared.value
        owns, ables = [x for x, _ in levels], [x for _, x in levels]
        digests = _Digests()
        counts: dict[tuple, int] = {}
        seen: set[tuple] = set()

        def out() -> pd.DataFrame:
            rows = [(*k, n) for k, n in counts.items()]
            return pd.DataFrame(rows, columns=["entity", "term", "again", *KEY, "n"]).astype(
                {"again": bool} | {c: "int64" for c in ("entity", "term", *KEY, "n")}
            )

        for batch in batches:
            maybe = in_filter(again, batch["row"].to_numpy()).tolist()
            for own, digest, text, twice in zip(
                batch["_lm_id"].tolist(), batch["_lm_text"].tolist(), batch["text"], maybe, strict=True
            ):
                spans = base_spans(text)
                if not spans or (twice and (own, digest) in seen):
                    continue
                entities = np.array(list(_entities(spans)), np.int64)
                # The last filter that passes an entity allows it the most terms.
                level = len(owns) - 1 - _lowest(owns[::-1], entities)
                if level.max() < 0:
                    continue
                key = (True, own, digest) if twice else (False, 0, 0)
                if twice:
                    seen.add((own, digest))
                words = {w for w, _, _ in words_outside(text, spans)}
                terms = np.fromiter((digests[w] for w in words), np.int64, len(words))
                lowest = _lowest(ables, terms)
                for entity, most in zip(entities.tolist(), level.tolist(), strict=True):
                    for term in terms[lowest <= most].tolist():
                        pair = (entity, term, *key)
                        counts[pair] = counts.get(pair, 0) + 1
                    if len(counts) > _PAIR_ROWS:
                        yield out()
                        counts = {}
                if len(seen) > _PAIR_ROWS:
                    seen = set()
        yield out()

    rows = keyed(docs, "text", F.xxhash64(*row_key()).alias("row"))
    parts = rows.mapInPandas(count, "entity long, term long, again boolean, _lm_id long, _lm_text long, n long")
    # Dealt by pair once; both sums work on that.
    parts = parts.repartition("entity", "term").groupBy("entity", "term", "again", *KEY).agg(F.sum("n").alias("n"))
    documents = F.sum(F.when(F.col("again"), F.lit(1)).otherwise(F.col("n")))
    return parts.groupBy("entity", "term").agg(documents.alias("n_both")).where(F.col("n_both") >= support)


def disclosures(
    docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """``(entity, term, disclosed, kind)`` of terms that reveal an entity too well."""
    # Repeated rows are one document in every count.
    rows = found.where(F.size("entities") > 0).dropDuplicates(KEY)
    entities = rows.select(F.explode("entities").alias("entity")).groupBy("entity")
    entities = entities.agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support)
    entities = stored(entities, "entity-counts")
    total = found.select(*KEY).distinct().count()
    again = _repeated(found)
    counts = stored(_document_counts(docs, again).where(F.col("n_term") >= support), "term-counts")
    pairs = stored(_pairs(docs, again, _levels(counts, entities, total, support, generalise), support), "pairs")
    joined = pairs.join(counts, "term").join(entities, "entity")
    mutual = F.log(F.lit(float(max(total, 1))) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    # An entity in every document holds no information that a term could give away.
    own = F.log(F.lit(float(max(total, 1))) / F.col("n_entity"))
    share = F.when(own > 0, mutual / own).otherwise(F.lit(0.0))
    kind = F.when(F.col("disclosed") >= remove, "removed").otherwise("generalised")
    judged = joined.select("entity", "term", share.alias("disclosed")).where(F.col("disclosed") >= generalise)
    return judged.withColumn("kind", kind)


def _places(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """``(row key, start, end, kind)`` of flagged terms, wherever they stand beside their entity."""
    filters = [membership_filter(flagged, c) for c in ("entity", "term")]
    mixed = F.expr("entity ^ (shiftleft(term, 1) | shiftrightunsigned(term, 63))").alias("pair")
    shared = docs.sparkSession.sparkContext.broadcast([*filters, membership_filter(flagged.select(mixed), "pair")])

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity_filter, term_filter, pair_filter = shared.value
        digests = _Digests()
        for batch in batches:
            out = []
            for own, digest, text in zip(
                batch["_lm_id"].tolist(), batch["_lm_text"].tolist(), batch["text"], strict=True
            ):
                spans = base_spans(text)
                entities = np.array(list(_entities(spans)), np.int64)
                entities = entities[in_filter(entity_filter, entities)]
                if not len(entities):
                    continue
                words = words_outside(text, spans)
                terms = np.fromiter((digests[w] for w, _, _ in words), np.int64, len(words))
                hit = np.flatnonzero(in_filter(term_filter, terms))
                at = np.array([w[1:] for w in words], np.int32).reshape(-1, 2)[hit]
                terms = terms[hit]
                code = terms.view(np.uint64)
                code = ((code << np.uint64(1)) | (code >> np.uint64(63))).view(np.int64)
                for entity in entities.tolist():
                    both = in_filter(pair_filter, code ^ np.int64(entity))
                    places = zip(terms[both].tolist(), *at[both].T.tolist(), strict=True)
                    out += [(own, digest, entity, *place) for place in places]
            names = [*KEY, "entity", "term", "start", "end"]
            yield pd.DataFrame(out, columns=names).astype("int64").astype({"start": "int32", "end": "int32"})

    schema = "_lm_id long, _lm_text long, entity long, term long, start int, end int"
    marked = keyed(docs, "text").mapInPandas(mark, schema)
    return marked.join(flagged, ["entity", "term"]).select(*KEY, "start", "end", "kind")


def spans(docs: DataFrame, **thresholds) -> DataFrame:
    """Per document: row key, ``doc_id, base`` spans and ``all`` spans, each by start and kind.

    Null and empty texts have none. Repeated rows come back as often, and count as one
    document in every count. Overlapping base spans all stay; a term
    inside a base span is none.
    """
    found = stored(find(docs), "personal-data")
    flagged = stored(disclosures(docs, found, **thresholds).select("entity", "term", "kind"), "disclosing-pairs")
    # A word beside two entities is one span; removal goes before generalisation.
    terms = _places(docs, flagged).groupBy(*KEY, "start", "end").agg(F.max("kind").alias("kind"))
    added = terms.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end", "kind")).alias("added"))
    every = F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))
    return found.join(added, KEY, "left").select(*KEY, "doc_id", "base", _sorted(every).alias("all"))


def _sorted(spans_):
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed_ = F.transform(
        spans_,
        lambda s: F.struct(
            s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")
        ),
    )
    return F.transform(
        F.array_sort(keyed_), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    )


def written(spans_: str):
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: str | None, spans_: list[tuple[int, int, str]]) -> str:
    """A text with base spans replaced by their kind, terms generalised to their shape or removed."""
    text = text or ""
    out, at = [], 0
    for start, end, kind in spans_:
        if end <= at:
            continue
        out.append(text[at : max(at, start)])
        word = text[max(at, start) : end]
        out.append("" if kind == "removed" else f"<word:{len(word)}>" if kind == "generalised" else f"<{kind}>")
        at = end
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, **thresholds) -> DataFrame:
    """The documents with all spans masked in their text; a null text stays null."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if t is None else masked(t, [] if m is None else [(s["start"], s["end"], s["kind"]) for s in m])
                for t, m in zip(texts, marks, strict=True)
            ],
            dtype=object,
        )

    own = [F.col(f"`{c}`") for c in docs.columns]
    marks = spans(docs, **thresholds).select(*KEY, F.col("all").alias("_lm_all")).where(F.size("_lm_all") > 0)
    rows = keyed(docs, F.struct(*own).alias("_lm_row")).join(marks.dropDuplicates(KEY), KEY, "left")
    return rows.select(
        *[
            (mask(F.col("_lm_row.text"), F.col("_lm_all")) if c == "text" else F.col("_lm_row").getField(c)).alias(c)
            for c in docs.columns
        ]
    )


def report(docs: DataFrame, **thresholds) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans."""

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans(docs, **thresholds).select(
        "doc_id", *map(count, KINDS[:4]), F.sha2(written("base"), 256).alias("base_sha256"), written("all").alias("spans")
    )
