"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CLOSERS, MAYBE_END, SIGNS
from ..operators.boundaries import DOT_RATE, LEAST_ABBREVIATION, LEAST_COLLOCATION, LEAST_STARTER, MOST

#: Added before rounding on both sides: means of round numbers lie on rounding's edge exactly, sums in another order not.
OFF_EDGE = 1.234e-9
QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, minus zero made zero; the SQL does the same by :func:`r`."""
    return df.select(*[(F.round(F.col(f"`{c}`") + F.lit(OFF_EDGE), digits) + F.lit(0.0)).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expression} + {OFF_EDGE}, {digits}) + 0.0" + (f' AS "{name}"' if name else "")


def sql_corr(x: str, y: str) -> str:
    """Pearson's r over rows where both are given, null where a side is constant."""
    return f"covar_samp({x}, {y}) / nullif(stddev_samp(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_samp(CASE WHEN {x} IS NOT NULL THEN {y} END), 0)"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _type(x: str) -> str:
    return f"lower(trim({x}, {_quoted(SIGNS)}))"


def _bare(x: str) -> str:
    return f"rtrim({x}, {_quoted(CLOSERS)})"


def _dotted(x: str) -> str:
    return f"(ends_with({_bare(x)}, '.') AND NOT ends_with({_bare(x)}, '..'))"


def _letter(x: str) -> str:
    return f"regexp_matches({x}, '\\p{{L}}')"


def _starts(x: str, kind: str) -> str:
    return f"regexp_matches(ltrim({x}, {_quoted(SIGNS)}), '^\\p{{{kind}}}')"


def _kind(x: str, names: str) -> str:
    letter = _letter(x)
    return f"CASE WHEN length({x}) = 1 THEN CASE WHEN {letter} THEN 'initial' ELSE 'number' END WHEN NOT {letter} THEN 'number' WHEN list_contains({names}, {x}) OR list_contains({names}, regexp_extract({x}, '[^-]*$')) THEN 'abbreviation' ELSE 'word' END"


def _ratio(a: str, b: str, ab: str, n: str) -> str:
    part = lambda k, m, x: f"(CASE WHEN {k} > 0 THEN {k} * ln({x}) ELSE 0 END + CASE WHEN {m} - ({k}) > 0 THEN ({m} - ({k})) * ln(1 - {x}) ELSE 0 END)"
    rest, more = f"({b} - {ab})", f"({n} - {a})"
    whole = f"({b} / {n})"
    return f"-2 * ({part(ab, a, whole)} + {part(rest, more, whole)} - {part(ab, a, f'({ab} / {a})')} - {part(rest, more, f'({rest} / {more})')})"


def sql_boundaries(source: str, x: str, most: int | None = MOST) -> str:
    """Common tables that learn sentence boundaries of the texts x of a table: bd_ab, bd_st, bd_co, bd_op and all as lists
    in bd; of each the best ``most``, or all."""
    best = lambda by: f" ORDER BY {by} LIMIT {most}" if most is not None else ""
    return (
        f"bd_tok AS (SELECT unnest(ws) AS w, unnest(list_transform(range(len(ws)), lambda i: ws[i])) AS p FROM (SELECT list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '') AS ws FROM {source})),"
        f" bd_t AS MATERIALIZED (SELECT {_type('w')} AS t, {_dotted('w')} AS d, {_starts('w', 'Lu')} AS u, {_type('p')} AS pt, {_dotted('p')} AS pd, right({_bare('p')}, 1) IN ('.', '!', '?') AS ps FROM bd_tok WHERE {_type('w')} <> ''),"
        " bd_ty AS MATERIALIZED (SELECT t, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (d) AS DOUBLE) AS k, count(*) FILTER (NOT u) AS low, count(*) FILTER (u AND NOT ps) AS mid FROM bd_t GROUP BY t),"
        " bd_tot AS MATERIALIZED (SELECT coalesce(sum(n), 0) AS n, least(coalesce(sum(k), 0) / nullif(sum(n), 0), 0.98) AS rate FROM bd_ty),"
        f" bd_ab AS MATERIALIZED (SELECT t, k, plain, score FROM (SELECT t, k, bd_ty.n - k AS plain, 2 * (k * ln({DOT_RATE} / greatest(rate, 1e-12)) + (bd_ty.n - k) * ln({1 - DOT_RATE} / (1 - rate))) * exp(-(length(replace(t, '.', '')))) * (length(t) - length(replace(t, '.', '')) + 1) * pow(length(replace(t, '.', '')), k - bd_ty.n) AS score FROM bd_ty, bd_tot WHERE k > 0 AND length(t) > 1 AND {_letter('t')}) WHERE score >= {LEAST_ABBREVIATION}{best('score DESC, t')}),"
        " bd_abl AS MATERIALIZED (SELECT coalesce(list(t), []) AS ab FROM bd_ab),"
        f" bd_pr AS MATERIALIZED (SELECT pt, t, n, caps, {_kind('pt', 'ab')} AS kind FROM (SELECT pt, t, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (u) AS caps FROM bd_t WHERE pd AND pt <> '' GROUP BY pt, t), bd_abl),"
        " bd_end AS (SELECT t, sum(n) AS at_end, sum(sum(n)) OVER () AS total FROM bd_pr WHERE kind = 'word' GROUP BY t),"
        f" bd_st AS MATERIALIZED (SELECT * FROM (SELECT t, at_end, bd_ty.n, {_ratio('total', 'bd_ty.n', 'at_end', 'bd_tot.n')} AS ratio FROM bd_end JOIN bd_ty USING (t), bd_tot WHERE at_end / total > bd_ty.n / bd_tot.n AND bd_tot.n > total) WHERE ratio >= {LEAST_STARTER}{best('ratio DESC, t')}),"
        f" bd_co AS MATERIALIZED (SELECT * FROM (SELECT pt, t, o.n, {_ratio('a.k', 'b.n', 'o.n', 'bd_tot.n')} AS ratio FROM bd_pr AS o JOIN bd_ty AS b USING (t) JOIN bd_ty AS a ON a.t = o.pt, bd_tot WHERE o.kind <> 'word' AND o.n > 1 AND o.n / a.k > b.n / bd_tot.n AND bd_tot.n > a.k) WHERE ratio >= {LEAST_COLLOCATION}{best('ratio DESC, pt, t')}),"
        f" bd_op AS MATERIALIZED (SELECT t, sum(caps) AS caps FROM bd_pr JOIN bd_ty USING (t) WHERE kind = 'abbreviation' AND caps > 0 AND low > 0 AND mid = 0 GROUP BY t{best('caps DESC, t')}),"
        " bd AS MATERIALIZED (SELECT ab, (SELECT coalesce(list(t), []) FROM bd_st) AS st, (SELECT coalesce(list(pt || ' ' || t), []) FROM bd_co) AS co, (SELECT coalesce(list(t), []) FROM bd_op) AS op FROM bd_abl)"
    )


def sql_sentences(source: str, keys: str, x: str) -> str:
    """A query of the keys and x, the list of sentences, of the texts x of a table; asks for :func:`sql_boundaries`."""
    last, first = "regexp_extract(p, '(\\S*)$', 1)", "regexp_extract(p, '^\\s*(\\S+)', 1)"
    return (
        "(WITH bq AS (SELECT row_number() OVER () AS bq, * FROM " + source + "),"
        f" bp AS (SELECT bq, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT bq, string_split(regexp_replace({x}, {_quoted(MAYBE_END)}, '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM bq)),"
        f" bw AS (SELECT bq, i, p, {last} AS last, {first} AS first FROM bp),"
        f" bm AS (SELECT bq, i, p, {_type('last')} AS a, CASE WHEN NOT ends_with({_bare('last')}, '.') THEN 'sign' WHEN ends_with({_bare('last')}, '..') THEN 'dots' ELSE {_kind(_type('last'), 'ab')} END AS kind,"
        f" {_type('first')} AS b, {_starts('first', 'Lu')} AS up, {_starts('first', 'Ll')} AS low, st, co, op FROM bw, bd),"
        " bn AS (SELECT bq, i, p, a, kind, co, lead(b) OVER w AS b, lead(up) OVER w AS up, lead(low) OVER w AS low, lead(list_contains(st, b)) OVER w AS starts, lead(list_contains(op, b)) OVER w AS opens, lead(i) OVER w AS later FROM bm WINDOW w AS (PARTITION BY bq ORDER BY i)),"
        " bc AS (SELECT bq, i, p, later IS NOT NULL AND CASE WHEN kind IN ('word', 'sign') THEN true WHEN kind = 'dots' THEN up WHEN list_contains(co, a || ' ' || b) THEN false"
        f" WHEN kind = 'abbreviation' THEN up AND (starts OR opens) WHEN kind = 'initial' THEN (up AND starts) OR NOT {_letter('b')} ELSE NOT low END AS cut FROM bn),"
        " bs AS (SELECT bq, string_split(regexp_replace(string_agg(p || CASE WHEN cut THEN chr(1) ELSE '' END, '' ORDER BY i), chr(1) || '\\s+', chr(1), 'g'), chr(1)) AS s FROM bc GROUP BY bq)"
        f" SELECT {keys}, s AS x FROM bq JOIN bs USING (bq))"
    )
