"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"

# Common function words of the four corpus languages.
STOP_WORDS = (
    "the of and to in that is was for with it on as be at by this have from or are not "
    "le la les de des du et en un une que qui dans pour par sur au est "
    "der die das und in den von zu mit sich nicht ein eine auf im dem des "
    "el los las de del y que en un una por con para se no al"
).split()

_STOPS = sorted(set(STOP_WORDS))
_LONGEST = max(map(len, _STOPS))


class Rule(NamedTuple):
    """A document passes when metric lies within [low, high]; None leaves that end open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Length, symbol, stop-word and line ratios. Ratios over nothing are 0.
RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("repeated_words", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("bullet_lines", "bullet_ratio", high=0.9),
    Rule("ellipsis_lines", "ellipsis_ratio", high=0.3),
)


def _let(value: Column, body) -> Column:
    """Bind value once for a lambda body; Catalyst would otherwise repeat it inside each nested lambda."""
    return F.transform(F.array(value), body)[0]


def _repeated(h: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more. h: hashes of the 3-word windows, in order."""

    def covered(p: Column) -> Column:
        last = F.size(p) - 1
        return F.aggregate(F.sequence(F.lit(0), last), F.lit(0), lambda a, k: a + F.when(k == last, 3).otherwise(F.least(F.lit(3), F.get(p, k + 1) - F.get(p, k))))

    def twins(s: Column) -> Column:
        n = F.size(s)
        at = lambda k: F.get(s, k)["h"]
        hit = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ((k > 0) & (at(k) == at(k - 1))) | ((k < n - 1) & (at(k) == at(k + 1))))
        return _let(F.sort_array(F.transform(hit, lambda k: F.get(s, k)["i"])), covered)

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(pairs, twins))


def metrics(text: str = "text") -> Column:
    """A struct of counts and ratios over a whole text.

    Null and empty texts count as having no words; every count is then 0. Windows are compared by 64-bit hash of
    their three words.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def words(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.struct(
            n.alias("n"),
            F.when(n < 4, 0).otherwise(_let(hashes, _repeated)).alias("repeat"),
            F.size(F.filter(w, lambda x: (F.length(x) <= _LONGEST) & F.lower(x).isin(_STOPS))).alias("stop"),
        )

    def lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).alias("n"),
            (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup"),
            F.size(F.filter(ls, lambda x: x.rlike(r"^\s*[-*•‣]\s"))).alias("bullet"),
            F.size(F.filter(ls, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("ellipsis"),
        )

    w = _let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), words)
    ln = _let(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), lines)
    raw = F.struct(w.alias("w"), ln.alias("l"), (F.length(t) - F.regexp_count(t, F.lit(SPACE))).alias("chars"), F.regexp_count(t, F.lit(SYMBOL)).alias("sym"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)

    def all_of(q: Column) -> Column:
        n, m = q["w"]["n"], q["l"]["n"]
        return F.struct(
            *(c.cast("long").alias(k) for k, c in {"n_words": n, "word_chars": q["chars"], "n_symbols": q["sym"], "n_dup_lines": q["l"]["dup"], "n_repeat_words": q["w"]["repeat"], "n_lines": m, "n_stop_words": q["w"]["stop"]}.items()),
            ratio(q["w"]["repeat"], n).alias("repeat_ratio"),
            ratio(q["chars"], n).alias("mean_word_chars"),
            ratio(q["sym"], n).alias("symbol_ratio"),
            ratio(q["w"]["stop"], n).alias("stop_ratio"),
            ratio(q["l"]["dup"], m).alias("dup_line_ratio"),
            ratio(q["l"]["bullet"], m).alias("bullet_ratio"),
            ratio(q["l"]["ellipsis"], m).alias("ellipsis_ratio"),
        )

    return _let(raw, all_of)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs plus q (the metrics), failed (names of the rules that a row breaks) and kept (none broken).

    One narrow projection: no shuffle and no Python. The verdict is one expression that binds the metrics once, so a
    filter on kept doesn't compute them again for each rule. Rows are judged alone, so repeated rows get the same
    verdict, whatever their ids; a null text has no words. Columns q, failed and kept of the input are replaced.
    """

    def judged(q: Column) -> Column:
        tests = []
        for r in rules:
            bad = [q[r.metric] < r.low] * (r.low is not None) + [q[r.metric] > r.high] * (r.high is not None)
            tests += [F.when(b, F.lit(r.name)) for b in bad]
        return F.struct(q.alias("q"), F.array_compact(F.array(*tests)).alias("failed"))

    name = "verdict_of_row"
    while name in docs.columns:
        name += "_"
    v = F.col(name)
    return docs.withColumn(name, _let(metrics(text), judged)).withColumns({"q": v["q"], "failed": v["failed"], "kept": F.size(v["failed"]) == 0}).drop(name)


def op3(docs: DataFrame) -> DataFrame:
    """The verdict table: base counts, base_failed and kept per document."""
    q = F.col("q")
    cols = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    return quality_rules(docs.select("doc_id", "text")).select("doc_id", *cols, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


_STOP_SQL = ", ".join(f"'{w}'" for w in _STOPS)
OP3_SQL = rf"""
with a as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
b as (
  select *, len(w) as n,
    case when len(w) < 3 then [] else list_transform(range(1, len(w) - 1), lambda i: struct_pack(i := i, k := w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as win
  from a),
u as (select doc_id, unnest(win) as x from b),
d as (select doc_id, x.i as i, count(*) over (partition by doc_id, x.k) as c from u),
r as (select doc_id, sum(least(3, coalesce(nxt - i, 3))) as rep from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from d where c > 1) group by doc_id),
m as (
  select b.doc_id, n as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(rep, 0) as n_repeat_words, len(ls) as n_lines,
    len(list_filter(w, lambda x: lower(x) in ({_STOP_SQL}))) as stops,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•‣]\s'))) as bullets,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) as dots
  from b left join r on b.doc_id = r.doc_id),
v as (
  select *, n_words < 50 as few, n_repeat_words * 1.0 / nullif(n_words, 0) > 0.5 as rp,
    coalesce(word_chars * 1.0 / nullif(n_words, 0), 0) as wl, coalesce(n_symbols * 1.0 / nullif(n_words, 0), 0) as sy, coalesce(stops * 1.0 / nullif(n_words, 0), 0) as st,
    coalesce(n_dup_lines * 1.0 / nullif(n_lines, 0), 0) as dl, coalesce(bullets * 1.0 / nullif(n_lines, 0), 0) as bu, coalesce(dots * 1.0 / nullif(n_lines, 0), 0) as el
  from m),
f as (
  select *, concat_ws(',', case when few then 'few_words' end, case when rp then 'repeated_words' end, case when wl < 2 then 'word_length' end, case when wl > 15 then 'word_length' end,
    case when sy > 0.1 then 'symbols' end, case when st < 0.02 then 'stop_words' end, case when dl > 0.5 then 'duplicate_lines' end, case when bu > 0.9 then 'bullet_lines' end, case when el > 0.3 then 'ellipsis_lines' end) as failed_rules
  from v)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, (few or 100 * n_repeat_words > 50 * n_words) as base_failed, (failed_rules = '' and not (few or 100 * n_repeat_words > 50 * n_words)) as kept
from f
"""
