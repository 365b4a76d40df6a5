"""Personal data by weak supervision, in DataFrame functions only (no Python code in the tasks).

Four strict patterns give the base spans. Looser patterns give further candidate spans. Every candidate,
base spans included, gets the votes of four labelers: its pattern and checks, a gazetteer, the words just
before it, and its shape. Expectation-maximisation over the counts of the vote patterns of the whole
corpus estimates how far each labeler can be relied on; a logistic span classifier is then trained on the
posteriors, weighted by those counts. Base spans stay; a further candidate is added if the classifier
gives it at least ``ACCEPT``.

Defined cases: null and empty texts have no span; spans of different kinds may overlap, an added span
that overlaps a base span is dropped; ids, repeated rows and other columns play no part. If no candidate
exists at all the model is empty and adds nothing. The fit collects one row per distinct cell of the
votes and features, whose number is bounded by their possible values (``MOST_CELLS``), not by the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract. Possessive forms and the look-behind only keep the matching linear in the
#: length of a text: a run is entered at its start or where the last match ended, and never given back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: What a text must hold before the pattern of a kind is tried at all.
GATE = {"email": "contains(text, '@')", "ip": r"text rlike '[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]'",
        "card": r"text rlike '[0-9](?:[ -]?[0-9]){11}'", "phone": "contains(text, '+')"}
#: Further candidates, by kind.
LOOSE = {
    "email_spoken": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}"
                    r" ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,10}",
    "phone_local": r"(?<![0-9+] ?)(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?",
}
LOOSE_GATE = {"email_spoken": "text rlike '[(\\\\[]at[)\\\\]]'", "phone_local": r"text rlike '[0-9]{3}[ .-][0-9]{4}'",
              "id_number": r"text rlike '[0-9]-[0-9]{2}-[0-9]{4}'", "name": r"text rlike '(?:Mr|Mrs|Ms|Dr|Prof)\\. [A-Z]'"}
KINDS = [*BASE, *LOOSE]
ACCEPT = 0.5
CONTEXT = 32
#: kinds x votes (3^4) x lengths (4): more distinct cells than this cannot occur.
MOST_CELLS = len(KINDS) * 81 * 4
#: Gazetteers (fixed values): top-level domains, dialling codes, first digits of card issuers, given names.
DOMAINS = "com org net edu gov io info biz de fr es uk it nl eu us ca au"
DIAL_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 86 90 91"
ISSUERS = "34 37 4 51 52 53 54 55 22 23 24 25 26 27 35 36 38 60 62 64 65"
NAMES = "james mary john anna peter maria thomas laura paul julia david sarah hans marie pierre carlos ana luis"
#: Words before a span that speak for it, and words that speak against it.
CUES_FOR = r"(?i)(?:mail|contact|phone|call|tel|fax|mobile|card|visa|account|ssn|address|name|ip|host|server|from|dear)[^0-9A-Za-z]{1,3}(?:[a-z]{1,6} )?$"
CUES_AGAINST = r"(?i)(?:version|isbn|order|page|section|figure|license|token|password|build|rfc)[^0-9A-Za-z]{1,3}(?:= ?\"?)?$"
VOTERS = ("pattern", "gazetteer", "context", "shape")
#: Matches of one kind are added up in runs of this length, so that the work stays near linear in their number.
RUN = 256


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(kind: str, pattern: str, gate: str) -> str:
    """SQL for an array of (start, end, kind, value, before) of the leftmost non-overlapping matches."""
    p = _literal(pattern)
    steps = "transform(m, (x, i) -> length(t[i]) + length(x))"
    runs = f"transform(sequence(0, (size(m) - 1) div {RUN}), c -> slice(steps, c * {RUN} + 1, {RUN}))"
    sums = "transform(runs, r -> aggregate(r, 0L, (a, x) -> a + x))"
    ends = ("flatten(transform(runs, (r, c) -> aggregate(r, struct(aggregate(slice(sums, 1, c), 0L, (a, x) -> a + x) as s, "
            "cast(array() as array<bigint>) as o), (a, x) -> struct(a.s + x as s, concat(a.o, array(a.s + x)) as o), a -> a.o)))")
    spans = (f"transform(m, (x, i) -> struct(ends[i] - length(x) as start, ends[i] as end, '{kind}' as kind, x as value, "
             f"right(t[i], {CONTEXT}) as before))")

    def let(name: str, value: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"
    body = let("m", f"regexp_extract_all(text, {p}, 0)", "CASE WHEN size(m) > 0 THEN " + let(
        "t", f"split(text, {p}, -1)", let("steps", steps, let("runs", runs, let("sums", sums, let("ends", ends, spans))))) + " END")
    return f"CASE WHEN {gate} THEN {body} END"


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_LUHN = ("element_at(transform(array(%s), d -> aggregate(sequence(1, length(d)), 0, (a, i) -> a + "
         "element_at(transform(array(cast(substring(d, length(d) - i + 1, 1) as int) * (2 - i %% 2)), y -> "
         "CASE WHEN y > 9 THEN y - 9 ELSE y END), 1)) %% 10 = 0), 1)") % _DIGITS
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
VALID = {
    "email": "true", "ip": rf"x.value rlike '^{_BYTE}(?:[.]{_BYTE})' || '{{3}}$'".replace("' || '", ""),
    "card": f"(length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN})",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _with(df: DataFrame, name: str, sql: str) -> DataFrame:
    return df.withColumn(name, F.expr(sql))


_EMPTY = "cast(array() as array<struct<start:bigint,end:bigint,kind:string,value:string,before:string>>)"


def candidates(texts: DataFrame) -> DataFrame:
    """Adds to a frame with a column ``text``: ``base`` (spans that pass their checks) and ``loose`` (further candidates)."""
    df = texts
    for kind, pattern in BASE.items():
        df = _with(df, f"m_{kind}", _matches(kind, pattern, GATE[kind]))
    ok = [f"coalesce(filter(m_{k}, x -> {VALID[k]}), {_EMPTY})" for k in BASE]
    df = _with(df, "base", f"concat({', '.join(ok)})")
    # digits that look like a card but fail its check are candidates too, for the labelers to refuse
    failed = (f"coalesce(transform(filter(m_card, x -> length({_DIGITS}) BETWEEN 13 AND 19 AND NOT {_LUHN}), "
              f"x -> struct(x.start, x.end, 'number' as kind, x.value, x.before)), {_EMPTY})")
    more = [f"coalesce({_matches(k, LOOSE[k], LOOSE_GATE[k])}, {_EMPTY})" for k in LOOSE]
    df = _with(df, "loose", f"concat({', '.join([failed, *more])})")
    df = _with(df, "loose", "CASE WHEN size(base) = 0 OR size(loose) = 0 THEN loose ELSE "
                            "filter(loose, x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end)) END")
    return df.drop(*[f"m_{k}" for k in BASE])


def _in(words: str) -> str:
    return ", ".join(f"'{w}'" for w in words.split())


#: The votes: 1 for personal data, -1 against it, 0 for no opinion.
VOTE = {
    "pattern": "CASE WHEN x.kind IN ('email', 'ip', 'card', 'phone', 'id_number') THEN 1 WHEN x.kind = 'number' THEN -1 ELSE 0 END",
    "gazetteer": f"""CASE
        WHEN x.kind LIKE 'email%' THEN CASE WHEN lower(trim(substring_index(translate(x.value, ')]', '..'), '.', -1))) IN ({_in(DOMAINS)}) THEN 1 ELSE -1 END
        WHEN x.kind = 'phone' THEN CASE WHEN substring({_DIGITS}, 1, 1) IN ({_in(DIAL_CODES)}) OR substring({_DIGITS}, 1, 2) IN ({_in(DIAL_CODES)}) THEN 1 ELSE 0 END
        WHEN x.kind IN ('card', 'number') THEN CASE WHEN substring({_DIGITS}, 1, 1) IN ({_in(ISSUERS)}) OR substring({_DIGITS}, 1, 2) IN ({_in(ISSUERS)}) THEN 1 ELSE -1 END
        WHEN x.kind = 'name' THEN CASE WHEN lower(regexp_extract(x.value, '[.] ([A-Za-z]+)', 1)) IN ({_in(NAMES)}) THEN 1 ELSE 0 END
        WHEN x.kind = 'ip' THEN CASE WHEN x.value rlike '^0*(?:0|127|255)[.]' THEN -1 ELSE 0 END
        ELSE 0 END""",
    "context": f"CASE WHEN x.before rlike {_literal(CUES_FOR)} THEN 1 WHEN x.before rlike {_literal(CUES_AGAINST)} THEN -1 ELSE 0 END",
    "shape": f"CASE WHEN length({_DIGITS}) >= 4 AND {_DIGITS} rlike '^(.)\\\\1*$' THEN -1 "
             f"WHEN length(x.value) BETWEEN 7 AND 64 THEN 1 ELSE 0 END",
}
CELL = "struct(x.kind as kind, " + ", ".join(f"{sql} as {v}" for v, sql in VOTE.items()) + \
       ", CASE WHEN x.end - x.start < 8 THEN 0 WHEN x.end - x.start < 16 THEN 1 WHEN x.end - x.start < 32 THEN 2 ELSE 3 END as size)"


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers, and the weights of the span classifier by feature."""
    reliability: dict
    weights: dict

    def score(self) -> str:
        """SQL for the classifier's probability of a cell ``c``."""
        terms = [repr(float(self.weights.get("bias", -20.0)))]
        for f, w in sorted(self.weights.items()):
            if f != "bias":
                name, value = f.split("=")
                value = value if name != "kind" else f"'{value}'"
                terms.append(f"CASE WHEN c.{name} = {value} THEN {float(w)!r}D ELSE 0D END")
        return f"1 / (1 + exp(-({' + '.join(terms)})))"


def _features(cell) -> list[str]:
    return ["bias", f"kind={cell['kind']}", *[f"{v}={cell[v]}" for v in VOTERS], f"size={cell['size']}"]


def fit(texts: DataFrame, rounds: int = 50, steps: int = 400) -> SpanModel:
    """Estimates the labelers' reliabilities and trains the classifier over the candidates of all ``texts``."""
    spans = candidates(texts.select("text")).select(F.explode(F.concat("base", "loose")).alias("x"))
    cells = spans.select(F.expr(CELL).alias("c")).groupBy("c").count().collect()
    assert len(cells) <= MOST_CELLS
    cells = [(r["c"].asDict(), r["count"]) for r in sorted(cells, key=lambda r: tuple(r["c"]))]
    # two latent classes; a voter's table holds P(vote | class) of the votes -1, 0, 1
    tables = {v: {1: {-1: .1, 0: .3, 1: .6}, 0: {-1: .5, 0: .3, 1: .2}} for v in VOTERS}
    prior, post = 0.5, [0.0] * len(cells)
    for _ in range(rounds):
        for i, (c, _n) in enumerate(cells):
            yes, no = math.log(prior), math.log(1 - prior)
            for v in VOTERS:
                yes, no = yes + math.log(tables[v][1][c[v]]), no + math.log(tables[v][0][c[v]])
            post[i] = 1 / (1 + math.exp(max(-500.0, min(500.0, no - yes))))
        total = sum(n for _, n in cells)
        prior = min(0.95, max(0.05, (1 + sum(p * n for p, (_, n) in zip(post, cells))) / (2 + total)))
        for v in VOTERS:
            for k in (0, 1):
                mass = [(c[v], n * (p if k else 1 - p)) for p, (c, n) in zip(post, cells)]
                whole = sum(m for _, m in mass) + 3
                tables[v][k] = {x: (1 + sum(m for y, m in mass if y == x)) / whole for x in (-1, 0, 1)}
    weights: dict[str, float] = {}
    total = sum(n for _, n in cells) or 1
    for _ in range(steps):
        grad: dict[str, float] = {}
        for p, (c, n) in zip(post, cells):
            fs = _features(c)
            z = sum(weights.get(f, 0.0) for f in fs)
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            for f in fs:
                grad[f] = grad.get(f, 0.0) + g
        for f, g in grad.items():
            weights[f] = weights.get(f, 0.0) - 2.0 * (g + 1e-4 * weights.get(f, 0.0))
    return SpanModel(tables, weights)


def _text_of(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


_RANK = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate([*KINDS, 'number'])) + " END"


def _ordered(spans: str) -> str:
    """By start, then kind as listed."""
    return (f"transform(array_sort(transform({spans}, x -> struct(x.start as start, {_RANK} as rank, x.end as end, x.kind as kind, "
            "x.value as value))), x -> struct(x.start as start, x.end as end, x.kind as kind, x.value as value))")


def find(texts: DataFrame, model: SpanModel) -> DataFrame:
    """Adds ``base_spans`` and ``spans`` (start, end, kind, value; code points, end exclusive) to a frame with ``text``."""
    df = candidates(texts)
    accept = f"element_at(transform(array({CELL}), c -> {model.score()} >= {ACCEPT}), 1)"
    df = _with(df, "loose", f"filter(loose, x -> {accept})")
    df = _with(df, "base_spans", f"CASE WHEN size(base) > 0 THEN {_ordered('base')} ELSE {_ordered(_EMPTY)} END")
    df = _with(df, "spans", f"CASE WHEN size(loose) > 0 THEN {_ordered('concat(base, loose)')} ELSE base_spans END")
    return df.drop("base", "loose")


def digest(docs: DataFrame, model: SpanModel) -> DataFrame:
    """The columns of the contract, per document."""
    df = find(docs.select("doc_id", "text"), model)
    counts = [F.expr(f"cast(size(filter(base_spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(F.expr(_text_of("base_spans")), 256).alias("base_sha256"),
                     F.expr(_text_of("spans")).alias("spans"))


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one,
    named after the first. Other columns stay, but ``n_chars``, if there is one, is counted anew."""
    cols = docs.columns
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col("text"))
    df = find(df, model)
    # spans in order, without those that begin inside an earlier one
    kept = ("aggregate(spans, struct(0L as upto, cast(array() as array<struct<start:bigint,end:bigint,kind:string>>) as o), (a, x) -> "
            "CASE WHEN x.start >= a.upto THEN struct(x.end as upto, concat(a.o, array(struct(x.start, x.end, x.kind))) as o) "
            "WHEN x.end > a.upto THEN struct(x.end as upto, concat(slice(a.o, 1, size(a.o) - 1), "
            "array(struct(element_at(a.o, -1).start, x.end, element_at(a.o, -1).kind))) as o) ELSE a END, a -> a.o)")
    df = _with(df, "kept", f"CASE WHEN size(spans) > 0 THEN {kept} END")
    parts = ("transform(kept, (x, i) -> concat(substring(text, int(CASE WHEN i = 0 THEN 1 ELSE kept[i - 1].end + 1 END), "
             "int(x.start - CASE WHEN i = 0 THEN 0 ELSE kept[i - 1].end END)), '<', upper(x.kind), '>'))")
    df = _with(df, "clean", f"CASE WHEN size(kept) > 0 THEN concat(array_join({parts}, ''), "
                            "substring(text, int(element_at(kept, -1).end + 1))) ELSE text END")
    out = {c: F.col("row").getField(c) for c in cols} | {"text": F.col("clean")}
    if "n_chars" in cols:
        out["n_chars"] = F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return df.select(*[out[c].alias(c) for c in cols])
