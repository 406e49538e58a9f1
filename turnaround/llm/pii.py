"""Personal data: patterns, and terms whose co-occurrence with protected entities gives these away."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnaround.llm import common
from turnaround.operators.joins import quoted
from turnaround.sources.storage import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Code points on either side of an entity whose whole words count as its context.
REACH = 100
#: Different contexts in which a term must stand beside an entity: as many as the entity's documents,
#: two at least and MIN_CONTEXTS at most.
MIN_CONTEXTS = 3
#: A term discloses an entity if their pointwise mutual information is this share of the entity's own
#: information; at 1.0 the term would stand nowhere in the corpus but beside that entity.
THRESHOLD = 0.9
#: Longer words are counted by their hash.
TERM_CHARS = 40
#: Terms sought in one pass over the texts (a broadcast of some 40 MB at most).
TERMS_A_PASS = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match starts within a run of digits: an earlier start in the run would have matched as well.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|=+-_/\\"
_loaded: dict = {}
common.keeps(__name__, _loaded.clear)

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Each @ is met once: the name is the run of name characters
    before it, so that long runs without an @ cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Pattern matches by start, then kind as listed; offsets in code points, end exclusive."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[1], order[x[0]]))


def term(word: str) -> str | None:
    """The form in which a word is counted: lower case, without marks at its ends; a hash of it behind a
    mark if it is long. None if nothing is left."""
    word = word.strip(_EDGE).lower()
    return (word if len(word) <= TERM_CHARS else "#" + xxhash.xxh3_128_hexdigest(word.encode())) or None


def _value(kind: str, text: str) -> str:
    return text.lower() if kind == "email" else text if kind == "ip" else "".join(c for c in text if c.isdigit())


def contexts(text: str) -> Iterator[tuple[str, str, int, int, set[str]]]:
    """For every entity of a text: its kind, value and place, and the terms that stand beside it."""
    spans = base_spans(text)
    taken = [(s, e) for _, s, e in spans]
    for kind, start, end in spans:
        beside: set[str] = set()
        for a, b in ((max(0, start - REACH), start), (end, min(len(text), end + REACH))):
            for m in _WORD.finditer(text, a, b):
                whole = (m.start() > a or a == 0 or text[a - 1].isspace()) and (
                    m.end() < b or b == len(text) or text[b].isspace()
                )
                if whole and not any(s < m.end() and m.start() < e for s, e in taken) and (t := term(m[0])):
                    beside.add(t)
        yield kind, _value(kind, text[start:end]), start, end, beside


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def joint_counts(docs: DataFrame) -> DataFrame:
    """`(entity, term, around, n)`: every term beside every entity in every context of a document, `n` one
    for the first of these and else zero; without a term, a row per entity and document.

    Mentions of an entity whose surroundings overlap are one context.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                if not _DIGIT.search(text) and "@" not in text:
                    continue
                beside: dict[tuple[str, str], list[list]] = {}
                for kind, value, start, end, terms in contexts(text):
                    met = beside.setdefault((kind, value), [])
                    if met and start - met[-1][0] < 2 * REACH:
                        met[-1] = [end, met[-1][1] | terms]
                    else:
                        met.append([end, terms])
                for (kind, value), met in beside.items():
                    entity, seen = _hash(f"{kind}:{value}"), set()
                    rows.append((entity, None, 0, 1))
                    for _, terms in met:
                        around = _hash(" ".join(sorted(terms)))
                        rows += [(entity, t, around, int(t not in seen)) for t in sorted(terms)]
                        seen |= terms
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["entity", "term", "around", "n"]
            )

    return common.map_batches(_texts(docs), run, "entity long, term string, around long, n long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"))


def _chunks(terms: DataFrame) -> Iterator[tuple[frozenset[str], str]]:
    """The terms in sets of bounded size; each term is in exactly one."""
    n = -(-terms.count() // TERMS_A_PASS)
    for i in range(n):
        part = terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i) if n > 1 else terms
        yield frozenset(r.term for r in part.select("term").toLocalIterator()), uuid.uuid4().hex


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """`(term, n_docs)` over all texts for the given terms, added up per task first."""
    spark, out = docs.sparkSession, None
    for sought, _ in _chunks(terms):
        shared = spark.sparkContext.broadcast(sought)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted, seen = shared.value, {}
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    for t in wanted.intersection(map(term, set(text.split()))):
                        seen[t] = seen.get(t, 0) + 1
            yield pa.RecordBatch.from_pydict(
                {"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())}
            )

        part = common.map_batches(_texts(docs), run, "term string, n long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("term").agg(F.sum("n").alias("n_docs")) if out is not None else None


def disclosing_terms(docs: DataFrame, threshold: float = THRESHOLD, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """`(term, disclosure)`: terms that give an entity away, over the whole corpus.

    With N documents, n(c) that hold entity c, n(t) that hold term t and n(c, t) in which t stands
    beside c, the pointwise mutual information is log(n(c,t) N / (n(c) n(t))) and c's own information
    log(N / n(c)). Their ratio, the largest over entities, is the disclosure. Copies of a passage show
    a term once: different contexts are needed, as many as the entity has documents, from two to
    `min_contexts`, so a rare word beside a copied address is not taken for its owner's name. An entity
    met in one context only tells nothing: every rare word beside it would score alike.
    """
    beside = materialize(joint_counts(docs), "entity-contexts")
    total = docs.count()
    entities = beside.where("term is null").groupBy("entity").agg(F.count("*").alias("n_c"))
    pairs = (
        beside.where("term is not null").groupBy("entity", "term", "around").agg(F.sum("n").alias("n"))
        .groupBy("entity", "term").agg(F.sum("n").alias("n_ct"), F.count("*").alias("n_around"))
        .where("n_around >= 2")
    )
    floor = F.greatest(F.lit(2), F.least(F.lit(min_contexts), F.col("n_c")))
    pairs = materialize(pairs.join(entities, "entity").where(F.col("n_around") >= floor), "entity-terms")
    found = document_counts(docs, pairs.select("term").distinct())
    if found is None:
        return docs.sparkSession.createDataFrame([], "term string, disclosure double")
    own = F.log(F.lit(float(max(total, 1))) / F.col("n_c"))
    mutual = F.log(F.col("n_ct") * F.lit(float(total)) / (F.col("n_c") * F.col("n_docs")))
    scored = pairs.join(found, "term").withColumn(
        "disclosure", F.when(own > 0, mutual / own).otherwise(F.when(F.col("n_ct") >= F.col("n_docs"), 1.0).otherwise(0.0))
    )
    return materialize(
        scored.groupBy("term").agg(F.max("disclosure").alias("disclosure"))
        .where(F.col("disclosure") >= threshold - 1e-12),
        "disclosing-terms",
    )


def term_spans(text: str, wanted: frozenset[str]) -> list[Span]:
    if not wanted or wanted.isdisjoint(map(term, set(text.split()))):
        return []
    out = []
    for m in _WORD.finditer(text):
        if term(m[0]) in wanted:
            start = m.start() + len(m[0]) - len(m[0].lstrip(_EDGE))
            out.append((TERM, start, start + len(m[0].strip(_EDGE))))
    return out


def sanitise(text: str, spans: list[Span]) -> str:
    """The text with every span generalised to its kind, `<EMAIL>`; spans that overlap become one,
    named after the first."""
    out, done = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[done:start], f"<{kind.upper()}>"]
        done = end
    return "".join(out) + text[done:]


def _write(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _read(text: str) -> list[Span]:
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in text.split(","))] if text else []


SPANS = {f"n_{k}": "long" for k in KINDS} | {"base_sha256": "string", "spans": "string"}


def scan(
    docs: DataFrame, keep: list[str] | None = None, replace: bool = False, prefix: str = "",
    threshold: float = THRESHOLD, min_contexts: int = MIN_CONTEXTS,
) -> DataFrame:
    """Every row of `docs` with its spans of personal data; `replace` sanitises the column `text`.

    `keep` names the columns to carry (default `doc_id`), which must hold `text` to replace it; added
    names get `prefix`. Spans are `kind:start:end`, by start, then kind, comma-joined, in code points:
    pattern matches first, then terms that disclose an entity (see `disclosing_terms`). A null text
    counts as empty, and stays null when replaced. Null ids, repeated rows and very long texts are
    rows like any other, taken whole; an empty table gives an empty result; no other column is read.
    """
    carried = keep if keep is not None else ["doc_id"]
    own = common.free_prefix([*carried, *(prefix + n for n in SPANS)])
    text_name, terms_name = f"{own}text", f"{own}terms"
    wanted = list(_chunks(disclosing_terms(docs, threshold, min_contexts))) or [(frozenset(), "none")]
    order = {k: i for i, k in enumerate((*KINDS, TERM))}
    sc = docs.sparkSession.sparkContext
    fields = [docs.select(*map(quoted, carried)).schema.toDDL()]
    added = ", ".join(f"`{prefix}{n}` {t}" for n, t in SPANS.items())
    out = docs.select(
        *map(quoted, carried), F.coalesce("text", F.lit("")).alias(text_name), F.lit("").alias(terms_name)
    )
    for i, (terms, _) in enumerate(wanted):
        shared: Broadcast = sc.broadcast(terms)
        last = i == len(wanted) - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, known = batch.column(text_name).to_pylist(), batch.column(terms_name).to_pylist()
                columns = [batch.column(j) for j in range(len(carried))]
                found = [_read(k) + term_spans(t, shared.value) for t, k in zip(texts, known)]
                if not last:
                    columns += [batch.column(text_name), pa.array([_write(f) for f in found], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, [*carried, text_name, terms_name])
                    continue
                base = [base_spans(t) for t in texts]
                spans = [
                    b + [t for t in f if not any(s < t[2] and t[1] < e for _, s, e in b)] for b, f in zip(base, found)
                ]
                spans = [sorted(x, key=lambda y: (y[1], order[y[0]])) for x in spans]
                if replace:
                    at = carried.index("text")
                    columns[at] = pa.array(
                        [None if t is None else sanitise(t, s) for t, s in zip(columns[at].to_pylist(), spans)], pa.string()
                    )
                columns += [pa.array([sum(k == x[0] for x in b) for b in base], pa.int64()) for k in KINDS]
                columns.append(pa.array([sha256(_write(b).encode()).hexdigest() for b in base], pa.string()))
                columns.append(pa.array([_write(s) for s in spans], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*carried, *(prefix + n for n in SPANS)])

        schema = ", ".join(fields) + ", " + (added if last else f"`{text_name}` string, `{terms_name}` string")
        out = common.map_batches(out if last else out, run, schema)
        if not last:
            out = materialize(out, "term-spans")
    return out
