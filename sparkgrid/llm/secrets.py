"""Secret scans: trigram queries derived from each rule pick the documents to verify."""

from __future__ import annotations

import re
import re._constants as tokens
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid.core import settle
from sparkgrid.llm.tables import pieces, text_of, texts_of

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: strings one position of a pattern may spell before it counts as open
SPELLINGS = 64
SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least length of one of its groups; shorter matches are dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


BASE = [
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # as long as [0-9a-f]+ of 32 characters or more: such runs are maximal
]
RULES = [
    *BASE,
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("repository", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]


def spellings(tree) -> list[set[str] | None]:
    """What each position of a pattern can spell: a set of strings, or None where that is open."""
    out: list[set[str] | None] = []
    for op, arg in tree:
        if op is tokens.LITERAL:
            out.append({chr(arg)})
        elif op is tokens.IN and all(o in (tokens.LITERAL, tokens.RANGE) for o, _ in arg):
            chars = {chr(c) for o, a in arg for c in ([a] if o is tokens.LITERAL else range(a[0], a[1] + 1))}
            out.append(chars if len(chars) <= SPELLINGS // 4 else None)
        elif op is tokens.SUBPATTERN:
            out += spellings(arg[-1])
        elif op is tokens.BRANCH:
            choices = [joined(spellings(branch)) for branch in arg[1]]
            out.append(None if None in choices else set().union(*choices))
        elif op in (tokens.MAX_REPEAT, tokens.MIN_REPEAT, tokens.POSSESSIVE_REPEAT):
            low, high, inner = arg
            out += [s for _ in range(min(low, 8)) for s in spellings(inner)]
            once = joined(spellings(inner))
            if low == 0 and high == 1 and once is not None:
                out.append(once | {""})
            elif high != low:
                out.append(None)
        else:
            out.append(None)
    return out


def joined(parts: list[set[str] | None]) -> set[str] | None:
    """All strings the positions spell together, None if open or too many."""
    found = {""}
    for part in parts:
        if part is None or len(found) * len(part) > SPELLINGS:
            return None
        found = {a + b for a, b in product(found, part)}
    return found


def trigram_query(pattern: str) -> list[list[set[str]]]:
    """Clauses that all hold in any matching text; a clause holds if one of its sets occurs whole.

    Runs of positions with few spellings become clauses, one set of trigrams
    for each spelling, in lower case like the index.  No clause: the pattern
    has no mandatory trigram.
    """
    clauses, run = [], {""}
    for part in [*spellings(parser.parse(pattern)), None]:
        longer = joined([run, part]) if part is not None else None
        if longer is not None:
            run = longer
            continue
        words = {s.lower() for s in run}
        if all(len(s) >= 3 for s in words):
            clauses.append([{s[i : i + 3] for i in range(len(s) - 2)} for s in sorted(words)])
        run = part if part is not None else {""}
    return clauses


def code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


def postings(docs: DataFrame, vocabulary: list[int] | None = None) -> DataFrame:
    """The inverted index: (trigram, docs) with one list of doc_ids per trigram and batch of rows.

    Trigrams are three bytes of the text in ASCII lower case, as a number.
    ``vocabulary`` keeps the index to the trigrams that queries name.
    """
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None
        if vocabulary is not None:
            wanted = np.zeros(1 << 24, dtype=bool)
            wanted[vocabulary] = True
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            found = []
            for text in (t for part in pieces(batch) for t in part.column("text").to_pylist()):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), dtype=np.uint8).astype(np.int32)
                codes = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:] if len(raw) > 2 else raw[:0]
                found.append(np.unique(codes if wanted is None else codes[wanted[codes]]))
            owner = np.repeat(np.arange(len(ids)), [len(f) for f in found])
            codes = np.concatenate(found) if found else np.zeros(0, np.int32)
            order = np.argsort(codes, kind="stable")
            terms, starts = np.unique(codes[order], return_index=True)
            offsets = pa.array(np.append(starts, len(codes)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids[owner[order]].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), lists], names=["trigram", "docs"])

    rows = docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(index, "trigram int, docs array<long>")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table handed over as Arrow: a list of tuples would pass through Python workers of its own, which stay."""
    return spark.createDataFrame(pa.table(list(map(list, zip(*rows, strict=True))), names=[c.split()[0] for c in schema.split(", ")]), schema)


def candidates(spark: SparkSession, docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query the document satisfies.

    The queries are a table of (rule, clause, choice, trigram), small and fixed
    by the rules.  Joined to the index it marks choices; a choice needs all its
    trigrams, a clause one choice, a rule all its clauses.
    """
    terms, needs = [], []
    for rule in rules:
        clauses = trigram_query(rule.pattern)
        needs.append((rule.kind, len(clauses)))
        for c, clause in enumerate(clauses):
            for i, grams in enumerate(clause):
                terms += [(rule.kind, c, i, len(grams), code(g)) for g in sorted(grams)]
    if not terms:
        return spark.createDataFrame([], "doc_id long, kinds array<string>")
    query = local_table(spark, terms, "kind string, clause int, choice int, grams int, trigram int")
    clauses = local_table(spark, needs, "kind string, clauses int")
    index = postings(docs, sorted({t[-1] for t in terms}))
    marked = index.join(F.broadcast(query), "trigram").select("kind", "clause", "choice", "grams", "trigram", F.explode("docs").alias("doc_id"))
    choices = marked.groupBy("doc_id", "kind", "clause", "choice", "grams").agg(F.count_distinct("trigram").alias("n")).filter("n = grams")
    hits = choices.groupBy("doc_id", "kind").agg(F.count_distinct("clause").alias("n")).join(F.broadcast(clauses), "kind")
    return hits.filter("n = clauses").groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def matches(rule: Rule, compiled: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for found in compiled.finditer(text):
        if found.end(rule.group) - found.start(rule.group) >= rule.least:
            yield found.span()


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, text, spans) of every row; other columns are not read."""
    return scan_rows(docs, rules, ["doc_id"]).select("row.doc_id", "text", "spans")


def scan_rows(docs: DataFrame, rules: list[Rule], carry: list[str], mark: str | None = None) -> DataFrame:
    """``row`` (a struct of the ``carry`` columns), ``text`` and ``spans`` of every row; a carried text is sent once.

    A rule's spans are its leftmost non-overlapping matches in the whole text
    (code points, end exclusive), by start and then rule order.  With ``mark``
    the text returned has it in place of the spans, and is null without any.  Rules with
    mandatory trigrams run on the documents the index names, others on all.

    A null text is empty and has no spans.  Rows without doc_id are verified
    under every rule; rows that repeat a doc_id under the rules of any of them;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    found = settle(candidates(spark, docs, rules))  # its size then decides how it is joined
    open_rules = {r.kind for r in rules if not trigram_query(r.pattern)}
    own = [] if "text" in carry else [text_of(docs).alias("text")]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in carry]).alias("row"), *own, docs["doc_id"].cast("long").alias("_id"))
    rows = rows.join(found, F.col("_id") == F.col("doc_id"), "left").drop("doc_id").withColumn("anonymous", F.col("_id").isNull()).drop("_id")
    schema = rows.select("row", F.lit(None).cast("string").alias("text"), F.lit(None).cast(SPANS).alias("spans")).schema

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in (b for whole in batches for b in pieces(whole)):
            spans, shown = [], []
            columns = (texts_of(batch), *(batch.column(c).to_pylist() for c in ("kinds", "anonymous")))
            for text, kinds, anonymous in zip(*columns, strict=True):
                own = [
                    (start, i, end) for i, rule in enumerate(rules)
                    if anonymous or rule.kind in open_rules or kinds and rule.kind in kinds
                    for start, end in matches(rule, compiled[i], text)
                ]
                spans.append([{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in sorted(own)])
                shown.append(text if mark is None else replaced(text, [(s, e) for s, _, e in sorted(own)], mark) if own else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(shown, pa.string()), pa.array(spans, kind_of)], names=["row", "text", "spans"])

    return rows.mapInArrow(verify, schema)


def replaced(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with each group of overlapping spans, given by start, replaced by ``mark``."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: list[Rule] = RULES, mark: str = "[secret]") -> DataFrame:
    """The rows with every span of their text replaced by ``mark`` and ``n_chars`` set anew.

    Overlapping spans are replaced together.  Rows without spans, and so null
    texts, stay as they are, as do all other columns.
    """
    scanned = scan_rows(docs, rules, docs.columns, mark)
    changed = F.size("spans") > 0
    new = {"text": F.col("text"), "n_chars": F.char_length("text")}
    return scanned.select(*[
        F.when(changed, new[c].cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c)
        for c in docs.columns
    ])
