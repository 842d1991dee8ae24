"""One query per operator over the derived lines, each with its SQL oracle where SQL has one."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import normalize as N
from parchmint.functions import text as T
from parchmint.operators import align, contract, dataset, layout, lexicon, metrics, ner, profile, report, split
from parchmint.plans import testbed
from parchmint.sources import lines as sources
from parchmint.plans.testbed import LINES_SQL, MARKS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = "", lines: bool = True) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` may use the views ``lines`` and those in ``views``."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            with_ = ", ".join(v.strip() for v in (LINES_SQL if lines else "", views) if v.strip())
            ORACLES[f.__name__] = (f"WITH {with_}\n" if with_ else "") + sql
        return f

    return register


_lines = testbed.lines


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("text", F.col("prediction"))


def _referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("text", F.col("reference"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Profiles and abbreviations.


@query("SELECT manuscript, count(DISTINCT image_id) AS pages, count(*) AS lines, avg(length(text)) AS mean_length, min(length(text)) AS min_length, max(length(text)) AS max_length FROM lines GROUP BY manuscript")
def ms_profile(spark, sf_dir):
    return profile.manuscript_profile(_lines(spark, sf_dir))


@query("SELECT count(DISTINCT manuscript) AS manuscripts, count(DISTINCT image_id) AS pages, count(*) AS lines FROM lines")
def corpus_totals(spark, sf_dir):
    return profile.corpus_totals(_lines(spark, sf_dir))


@query(f"SELECT line_id, regexp_extract_all(reference, '{MARKS_SQL}') AS marks FROM lines WHERE has_abbreviation")
def abbrev_lines(spark, sf_dir):
    lines = _lines(spark, sf_dir).where("has_abbreviation")
    return lines.select("line_id", T.abbreviations(F.col("reference")).alias("marks"))


@query("SELECT manuscript, count(*) AS lines, count(*) FILTER (WHERE has_abbreviation) AS abbreviated, avg(has_abbreviation::INT) AS rate FROM lines GROUP BY manuscript")
def abbrev_rate_by_ms(spark, sf_dir):
    return profile.abbreviation_rates(_referenced(spark, sf_dir))


_MARKS_VIEW = f"marks AS (SELECT manuscript, ordinal, unnest(regexp_extract_all(reference, '{MARKS_SQL}')) AS mark FROM lines)"


@query(
    "SELECT manuscript, mark, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY manuscript ORDER BY n DESC, mark) AS rank FROM (SELECT manuscript, mark, count(*) AS n FROM marks GROUP BY GROUPING SETS ((manuscript, mark), (mark)))) WHERE rank <= 10",
    _MARKS_VIEW,
)
def abbrev_top10_by_ms(spark, sf_dir):
    return profile.top_abbreviations(_referenced(spark, sf_dir))


@query("SELECT mark, manuscript, count(*) AS n, min(ordinal)::VARCHAR AS first FROM marks GROUP BY GROUPING SETS ((mark, manuscript), (mark))", _MARKS_VIEW)
def abbrev_rollup(spark, sf_dir):
    return profile.abbreviation_counts(_referenced(spark, sf_dir)).withColumn("first", F.col("first").cast("string"))


_FREQ_VIEWS = """
p AS (SELECT c AS char, count(*) AS n FROM (SELECT unnest(string_split(prediction, '')) AS c FROM lines) WHERE c <> '' GROUP BY c),
r AS (SELECT c AS char, count(*) AS n FROM (SELECT unnest(string_split(reference, '')) AS c FROM lines) WHERE c <> '' GROUP BY c),
both_sides AS (SELECT coalesce(p.char, r.char) AS char, coalesce(p.n, 0) AS freq_predictions, coalesce(r.n, 0) AS freq_references FROM p FULL JOIN r ON p.char = r.char)
"""
_CLASS_SQL = """CASE WHEN regexp_matches(char, '[\\x{0303}\\x{0305}\\x{033E}\\x{0360}\\x{0361}\\x{0363}-\\x{036F}]') OR regexp_matches(char, '\\p{M}') THEN 'combining_mark'
  WHEN regexp_matches(char, '[\\x{A720}-\\x{A7FF}]') THEN 'abbreviation' WHEN regexp_matches(char, '[\\x{204A}\\x{00B6}\\x{00F7}\\x{204B}\\x{2E19}]') THEN 'special_punctuation'
  WHEN regexp_matches(char, '\\p{L}') THEN 'latin' WHEN regexp_matches(char, '[\\p{P}\\p{S}]') THEN 'special_punctuation' ELSE 'other' END"""


@query("SELECT char, n FROM r", _FREQ_VIEWS)
def char_freq(spark, sf_dir):
    return profile.char_frequencies(_referenced(spark, sf_dir))


@query(f"SELECT class, count(*) AS kinds, sum(n)::BIGINT AS n FROM (SELECT *, {_CLASS_SQL} AS class FROM r) GROUP BY class", _FREQ_VIEWS)
def char_class(spark, sf_dir):
    freq = profile.char_frequencies(_referenced(spark, sf_dir)).withColumn("class", T.char_class(F.col("char")))
    return freq.groupBy("class").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))


@query(
    f"SELECT char, freq_predictions, freq_references, {_CLASS_SQL} AS class, 'U+' || upper(lpad(to_hex(unicode(char)), greatest(4, length(to_hex(unicode(char))))::INT, '0')) AS codepoint, freq_references > 0 AND freq_predictions = 0 AS missing FROM both_sides",
    _FREQ_VIEWS,
)
def alphabet(spark, sf_dir):
    return profile.alphabet(_predicted(spark, sf_dir), _referenced(spark, sf_dir), names=False)


_NAMES = ", ".join(f"(chr({c}), {_q(unicodedata.name(chr(c)))})" for r in ((32, 0x250), (0x300, 0x370), (0x2000, 0x2070), (0xA720, 0xA800)) for c in range(*r) if unicodedata.name(chr(c), ""))


@query(
    f"SELECT b.char, freq_predictions, freq_references, {_CLASS_SQL.replace('char', 'b.char')} AS class, 'U+' || upper(lpad(to_hex(unicode(b.char)), greatest(4, length(to_hex(unicode(b.char))))::INT, '0')) AS codepoint, freq_references > 0 AND freq_predictions = 0 AS missing, coalesce(name, 'UNKNOWN') AS unicode_name FROM both_sides b LEFT JOIN names ON names.char = b.char",
    f"{_FREQ_VIEWS.strip()}, names AS (SELECT * FROM (VALUES {_NAMES}) t(char, name))",
)
def alphabet_names(spark, sf_dir):
    return profile.alphabet_order(profile.alphabet(_predicted(spark, sf_dir), _referenced(spark, sf_dir)))


@query("SELECT count(*) FILTER (WHERE freq_predictions > 0) AS in_predictions, count(*) FILTER (WHERE freq_references > 0) AS in_references, count(*) AS total, count(*) FILTER (WHERE freq_references > 0 AND freq_predictions = 0) AS missing FROM both_sides", _FREQ_VIEWS)
def alphabet_summary(spark, sf_dir):
    return profile.alphabet_summary(profile.alphabet(_predicted(spark, sf_dir), _referenced(spark, sf_dir), names=False))


_MANGLED_VIEW = "q AS (SELECT DISTINCT c FROM (SELECT unnest(string_split(translate(prediction, 'xyzwkj', ''), '')) AS c FROM lines))"


@query("SELECT char, n FROM r ANTI JOIN q ON r.char = q.c", f"{_FREQ_VIEWS.strip()}, {_MANGLED_VIEW}")
def alphabet_missing(spark, sf_dir):
    weak = _lines(spark, sf_dir).withColumn("text", F.translate("prediction", "xyzwkj", ""))
    return profile.missing_characters(weak, _referenced(spark, sf_dir))


# Tokens and normalisation.

_TOKENS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}_]'))"


@query(f"SELECT line_id, len({_TOKENS.format(x='reference')}) AS tokens FROM lines")
def tokenize_counts(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_id", F.size(T.tokens(F.col("reference"))).alias("tokens"))


def _normal_sql(x: str, mode: str) -> str:
    x = f"nfc_normalize(regexp_replace({x}, '[\\x{{FEFF}}\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}]', '', 'g'))"
    for tag in N.EDITORIAL:
        x = f"regexp_replace({x}, {_q(tag)}, '', 'g')"
    for a, b in N.rules_for(mode):
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    return f"trim(regexp_replace({x}, ' {{2,}}', ' ', 'g'))"


@query(f"SELECT line_id, {_normal_sql('reference', 'diplomatic')} AS clean FROM lines")
def norm_diplo(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_id", N.normalize_text(F.col("reference")).alias("clean"))


@query(f"SELECT line_id, {_normal_sql('reference', 'normalized')} AS clean FROM lines")
def norm_full(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_id", N.normalize_text(F.col("reference"), "normalized").alias("clean"))


def _rule_frame(spark: SparkSession) -> DataFrame:
    rows = [(i, a, b) for i, (a, b) in enumerate((*N.DIPLOMATIC, *N.GRAPHIC))]
    rules = spark.createDataFrame(rows, "ordinal long, pattern string, replacement string")
    return rules.withColumn("mode", F.when(T.has_abbreviation(F.col("pattern")), "diplomatic").otherwise("normalized"))


@query(f"SELECT CASE WHEN regexp_matches(pattern, '{MARKS_SQL}') THEN 'diplomatic' ELSE 'normalized' END AS mode, count(*) AS n FROM (VALUES {', '.join(f'({_q(a)})' for a, _ in (*N.DIPLOMATIC, *N.GRAPHIC))}) t(pattern) GROUP BY 1", lines=False)
def norm_rules(spark, sf_dir):
    return _rule_frame(spark).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


# Lexicon, dictionary and coverage.

_CLEAN_VIEW = f"clean AS (SELECT *, {_normal_sql('prediction', 'diplomatic')} AS clean_p, {_normal_sql('reference', 'diplomatic')} AS clean_r FROM lines)"
_LEXICON_VIEW = f"""
tokens AS (SELECT lower(unnest({_TOKENS.format(x='clean_p')})) AS form, string_split(manuscript, '_')[1] AS manuscript, ordinal, has_abbreviation FROM clean),
lexicon AS (SELECT form, count(*) AS freq, list_sort(list(DISTINCT manuscript)) AS manuscripts, arg_min(has_abbreviation, ordinal) AS has_abbreviation, min(ordinal) AS first_ordinal, count(*) = 1 AS hapax FROM tokens GROUP BY form)
"""
_DICT_VIEW = f"dict AS (SELECT DISTINCT form FROM (SELECT lower(unnest({_TOKENS.format(x='clean_r')})) AS form FROM clean) WHERE length(form) >= 2)"
_LOOKUP_VIEW = "looked AS (SELECT *, form IN (SELECT form FROM dict) OR strip_accents(form) IN (SELECT form FROM dict) AS known FROM lexicon WHERE freq >= 2)"
_LEXICON_VIEWS = f"{_CLEAN_VIEW}, {_LEXICON_VIEW.strip()}"
_COVERAGE_VIEWS = f"{_LEXICON_VIEWS}, {_DICT_VIEW}, {_LOOKUP_VIEW}"


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.lexicon(_lines(spark, sf_dir).withColumn("clean", N.normalize_text(F.col("prediction"))))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms of the references; predictions differ from them where they are noisy."""
    return lexicon.dictionary_from_lines(_referenced(spark, sf_dir))


def _looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.dictionary_lookup(_lexicon(spark, sf_dir), _dictionary(spark, sf_dir))


@query("SELECT form, freq, manuscripts, has_abbreviation, first_ordinal::VARCHAR AS first_ordinal, hapax FROM lexicon", _LEXICON_VIEWS)
def lexicon_forms(spark, sf_dir):
    return _lexicon(spark, sf_dir).withColumn("first_ordinal", F.col("first_ordinal").cast("string"))


@query("SELECT count(*) AS forms, count(*) FILTER (WHERE hapax) AS hapax, avg(hapax::INT) AS rate FROM lexicon", _LEXICON_VIEWS)
def hapax_rate(spark, sf_dir):
    return lexicon.hapax_rate(_lexicon(spark, sf_dir))


@query("SELECT form FROM dict", f"{_CLEAN_VIEW}, {_DICT_VIEW}")
def dict_build(spark, sf_dir):
    return _dictionary(spark, sf_dir)


@query("SELECT form, known FROM looked", _COVERAGE_VIEWS)
def dict_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir).select("form", "known")


@query(
    """SELECT n AS forms, k AS known, n - k AS unknown, k / n AS rate, (k - ka) / greatest(1, n - ua) AS rate_plain, (k - ka) / (n - ua - ka) AS rate_plain_exact,
    CASE WHEN ka + ua = 0 THEN 0.0::DOUBLE ELSE ka / (ka + ua) END AS rate_abbr FROM (SELECT count(*) AS n, count(*) FILTER (WHERE known) AS k, count(*) FILTER (WHERE known AND has_abbreviation) AS ka, count(*) FILTER (WHERE NOT known AND has_abbreviation) AS ua FROM looked)""",
    _COVERAGE_VIEWS,
)
def coverage(spark, sf_dir):
    return lexicon.coverage(_looked_up(spark, sf_dir))


_UNKNOWN_VIEW = f"unknown AS (SELECT *, CASE WHEN regexp_matches(form, '{MARKS_SQL}') THEN 'unexpanded_abbreviation' WHEN length(form) <= 2 THEN 'fragment' WHEN freq <= 3 AND NOT has_abbreviation THEN 'probable_error' ELSE 'rare_or_dialectal' END AS reason FROM looked WHERE NOT known)"


@query("SELECT reason, count(*) AS n FROM unknown GROUP BY reason", f"{_COVERAGE_VIEWS}, {_UNKNOWN_VIEW}")
def oov_classes(spark, sf_dir):
    return lexicon.unknown_reasons(lexicon.unknown_forms(_looked_up(spark, sf_dir)))


@query("SELECT form, freq, reason FROM unknown ORDER BY freq DESC, first_ordinal, form LIMIT 500", f"{_COVERAGE_VIEWS}, {_UNKNOWN_VIEW}")
def oov_top500(spark, sf_dir):
    return lexicon.top_unknown(lexicon.unknown_forms(_looked_up(spark, sf_dir))).select("form", "freq", "reason")


# Error rates.

#: DuckDB's edit distance counts bytes: other characters become unused control characters first.
_FOREIGN = "\u00a0ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü⁊ꝙꝯꝑ"
_CONTROLS = " || ".join(f"chr({i})" for i in (*range(1, 9), *range(14, 32), 127))
_ASCII = lambda x: f"translate({x}, '{_FOREIGN}' || chr(771), {_CONTROLS})"
_LEV = lambda a, b: f"levenshtein({_ASCII(a)}, {_ASCII(b)})"
_CER_SQL = lambda p: f"CASE WHEN length(reference) = 0 THEN (CASE WHEN length({p}) = 0 THEN 0.0 ELSE 1.0 END)::DOUBLE ELSE {_LEV(p, 'reference')} / length(reference) END"
_WORDS_VIEW = "worded_pairs AS (SELECT *, list_filter(regexp_split_to_array(prediction, '\\s+'), lambda x: x <> '') AS wp, list_filter(regexp_split_to_array(reference, '\\s+'), lambda x: x <> '') AS wr FROM lines), coded AS (SELECT *, list_distinct(list_concat(wp, wr)) AS v FROM worded_pairs)"
_CODE = lambda w: f"array_to_string(list_transform({w}, lambda x: chr((32 + list_position(v, x))::INT)), '')"
_RATES_VIEW = f"{_WORDS_VIEW}, rates AS (SELECT *, {_CER_SQL('prediction')} AS cer, CASE WHEN len(wr) = 0 THEN (CASE WHEN len(wp) = 0 THEN 0.0 ELSE 1.0 END)::DOUBLE ELSE levenshtein({_CODE('wp')}, {_CODE('wr')}) / len(wr) END AS wer FROM coded)"
_STRATA = "SELECT coalesce(avg({r}), 0.0) AS overall, avg({r}) FILTER (WHERE has_abbreviation) AS abbreviated, avg({r}) FILTER (WHERE NOT has_abbreviation) AS plain, count(*) FILTER (WHERE has_abbreviation) AS n_abbreviated, count(*) FILTER (WHERE NOT has_abbreviation) AS n_plain, avg({r}) FILTER (WHERE has_abbreviation) - avg({r}) FILTER (WHERE NOT has_abbreviation) AS delta FROM rates"


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.line_rates(_lines(spark, sf_dir))


@query("SELECT line_id, cer FROM rates", _RATES_VIEW)
def cer_lines(spark, sf_dir):
    return _rates(spark, sf_dir).select("line_id", "cer")


@query("SELECT line_id, wer FROM rates", _RATES_VIEW)
def wer_lines(spark, sf_dir):
    return _rates(spark, sf_dir).select("line_id", "wer")


@query(_STRATA.format(r="cer"), _RATES_VIEW)
def cer_stratified(spark, sf_dir):
    return metrics.stratified(_rates(spark, sf_dir))


@query(_STRATA.format(r="wer"), _RATES_VIEW)
def wer_stratified(spark, sf_dir):
    return metrics.stratified(_rates(spark, sf_dir), "wer")


@query(f"SELECT mark, avg(cer) AS mean_cer, count(*) AS n FROM (SELECT cer, unnest(regexp_extract_all(reference, '{MARKS_SQL}')) AS mark FROM rates) GROUP BY mark", _RATES_VIEW)
def err_by_char(spark, sf_dir):
    return metrics.errors_by_character(_rates(spark, sf_dir))


@query(
    "SELECT b, c, CASE WHEN b + c = 0 THEN 0.0::DOUBLE ELSE pow(abs(b - c) - 1, 2) / (b + c) END AS chi2 FROM (SELECT count(*) FILTER (WHERE prediction <> reference AND prediction2 = reference) AS b, count(*) FILTER (WHERE prediction = reference AND prediction2 <> reference) AS c FROM lines)"
)
def mcnemar_counts(spark, sf_dir):
    errors = _lines(spark, sf_dir).select((F.col("prediction") != F.col("reference")).alias("e1"), (F.col("prediction2") != F.col("reference")).alias("e2"))
    return metrics.mcnemar_counts(errors)


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE cer = 0) AS perfect, avg(cer) AS mean_rate, max(cer) AS worst_rate FROM rates", _RATES_VIEW)
def pair_report(spark, sf_dir):
    return metrics.pair_summary(_lines(spark, sf_dir))


@query("SELECT line_id, cer FROM rates ORDER BY cer DESC, ordinal LIMIT 5", _RATES_VIEW)
def worst5_cer(spark, sf_dir):
    return metrics.worst_pairs(_rates(spark, sf_dir)).select("line_id", "cer")


@query(
    """SELECT p.line_id, coalesce(r.reference, q.reference) AS reference FROM lines p
    LEFT JOIN (SELECT key, arg_max(reference, position) AS reference FROM keyed GROUP BY key) r ON p.line_id = r.key LEFT JOIN keyed q ON p.ordinal = q.position WHERE coalesce(r.reference, q.reference) IS NOT NULL""",
    "keyed AS (SELECT position, reference, CASE WHEN lost THEN 'lost' WHEN h % 4 = 2 THEN position::VARCHAR ELSE line_id END AS key FROM (SELECT *, h % 9 = 0 AS lost, CASE WHEN h % 9 = 0 THEN -1 - ordinal ELSE ordinal END AS position FROM lines))",
)
def pair_join(spark, sf_dir):
    """References without an id pair by position; some have an id and a position that no prediction has."""
    lines, lost = _lines(spark, sf_dir), F.col("h") % 9 == 0
    position = F.when(lost, -1 - F.col("ordinal")).otherwise(F.col("ordinal")).cast("decimal(38,0)")
    refs = lines.select(position.alias("position"), F.when(lost, "lost").when(F.col("h") % 4 != 2, F.col("line_id")).alias("line_id"), F.col("reference").alias("text"))
    preds = lines.select(F.col("ordinal").alias("position"), "line_id", F.col("prediction").alias("text"))
    return metrics.pair_lines(preds, refs).select("line_id", "reference")


_T = lambda x: _TOKENS.format(x=x)
_PRF_VIEWS = f"""
toks AS (SELECT *, {_T('prediction')} AS a, {_T('reference')} AS b FROM lines),
overlap AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) AS tp, len(a) AS np, len(b) AS nr FROM toks WHERE len(a) > 0 OR len(b) > 0),
pr AS (SELECT *, CASE WHEN np > 0 THEN tp::DOUBLE / np ELSE 0.0 END::DOUBLE AS precision, CASE WHEN nr > 0 THEN tp::DOUBLE / nr ELSE 0.0 END::DOUBLE AS recall FROM overlap),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END::DOUBLE AS f1 FROM pr)
"""


@query("SELECT line_id, precision, recall, f1 FROM prf", _PRF_VIEWS)
def token_prf_lines(spark, sf_dir):
    return metrics.token_scores(_lines(spark, sf_dir)).select("line_id", "precision", "recall", "f1")


@query("SELECT stratum, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, count(*) AS lines FROM (SELECT *, unnest(['all', CASE WHEN has_abbreviation THEN 'abbreviated' ELSE 'plain' END]) AS stratum FROM prf) GROUP BY stratum", _PRF_VIEWS)
def token_prf_macro(spark, sf_dir):
    return metrics.token_summary(metrics.token_scores(_lines(spark, sf_dir)))


@query("SELECT line_id, f1 FROM prf WHERE f1 < 0.5 ORDER BY round(f1, 4), ordinal LIMIT 20", _PRF_VIEWS)
def worst20(spark, sf_dir):
    return metrics.worst_lines(metrics.token_scores(_lines(spark, sf_dir))).select("line_id", "f1")


@query(
    """SELECT measure, avg(x) AS mean, quantile_cont(x, 0.025) AS lower, quantile_cont(x, 0.975) AS upper
    FROM (SELECT unnest(['overall', 'abbreviated', 'plain', 'delta']) AS measure, unnest([overall, abbreviated, plain, abbreviated - plain]) AS x FROM means) WHERE x IS NOT NULL GROUP BY measure""",
    f"""{_RATES_VIEW}, places AS (SELECT cer, has_abbreviation AS f, ('0x' || substr(md5(ordinal::VARCHAR), 1, 8))::BIGINT % {metrics.PRIME} AS h FROM rates),
    reps AS (SELECT r, ('0x' || substr(md5('a' || r), 1, 8))::BIGINT % {metrics.PRIME - 1} + 1 AS a, ('0x' || substr(md5('b' || r), 1, 8))::BIGINT % {metrics.PRIME} AS b FROM range(1000) t(r)),
    draws AS (SELECT r, cer, f, (h * a + b) % {metrics.PRIME} AS x FROM places, reps),
    counted AS (SELECT r, cer, f, {" + ".join(f"(x >= {c})::INT" for c in metrics.CUTS)} AS k FROM draws),
    means AS (SELECT r, sum(k * cer) / sum(k) AS overall, sum(k * cer) FILTER (WHERE f) / sum(k) FILTER (WHERE f) AS abbreviated, sum(k * cer) FILTER (WHERE NOT f) / sum(k) FILTER (WHERE NOT f) AS plain FROM counted GROUP BY r)""",
)
def bootstrap_ci(spark, sf_dir):
    return metrics.bootstrap(_rates(spark, sf_dir), position="ordinal")


@query()
def evaluation_report(spark, sf_dir):
    return report.evaluation(_rates(spark, sf_dir), position="ordinal")


# Delivery.

_WHITE_SQL = " || ".join(f"chr({ord(c)})" for c in T.WHITE)
#: Some predictions are but three letters between tabs and line ends.
_PADDED_VIEW = "padded AS (SELECT * REPLACE (CASE WHEN h % 31 = 0 THEN chr(9) || chr(9) || left(prediction, 3) || chr(160) || chr(10) ELSE prediction END AS prediction) FROM lines)"
_REVIEW = f"(length(trim(prediction, {_WHITE_SQL})) < 5 OR confidence < 0.6 OR (has_abbreviation AND confidence < 1.2::DOUBLE * 0.6::DOUBLE) OR {_LEV('prediction', 'prediction2')}::DOUBLE / greatest(1, length(prediction)) > 0.3)"


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = contract.needs_review(F.col("prediction"), F.col("confidence"), F.col("has_abbreviation"), F.col("prediction2"))
    padded = F.when(F.col("h") % 31 == 0, F.concat(F.lit("\t\t"), F.left("prediction", F.lit(3)), F.lit("\xa0\n"))).otherwise(F.col("prediction"))
    return _lines(spark, sf_dir).withColumn("prediction", padded).withColumn("needs_review", flag)


@query(f"SELECT line_id, {_REVIEW} AS needs_review FROM padded", _PADDED_VIEW)
def review_flags(spark, sf_dir):
    return _reviewed(spark, sf_dir).select("line_id", "needs_review")


@query(f"SELECT count(*) AS lines, count(*) FILTER (WHERE r) AS review, avg(r::INT) AS review_rate, count(*) FILTER (WHERE has_abbreviation) AS abbreviated, count(*) FILTER (WHERE has_abbreviation AND r) AS abbreviated_review FROM (SELECT *, {_REVIEW} AS r FROM padded)", _PADDED_VIEW)
def review_summary(spark, sf_dir):
    return contract.review_summary(_reviewed(spark, sf_dir))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliverables of which the line's hash breaks some fields."""
    h = F.col("h")
    point = F.array(F.lit(0.0), F.lit(1.0))
    return _reviewed(spark, sf_dir).select(
        "ordinal", F.when(h % 11 != 0, F.when(h % 13 == 0, "").otherwise(F.col("image_id"))).alias("image_id"), "line_id", F.col("prediction").alias("transcription"),
        F.when(h % 17 == 0, 1.5).when(h % 19 == 0, -0.1).otherwise(F.col("confidence")).alias("confidence"), "needs_review", "has_abbreviation",
        F.when(h % 23 == 0, F.array(point, point)).when(h % 29 == 0, F.array(point, F.array(F.lit(1.0)), point)).otherwise(F.array(point, point, point)).alias("polygon"),
        F.concat(F.lit("segmentations/"), "image_id", F.lit(".xml")).alias("page_xml_ref"),
    )


_ERRORS = "list_filter([CASE WHEN h % 11 = 0 THEN 'image_id is missing' END, CASE WHEN h % 11 <> 0 AND h % 13 = 0 THEN 'image_id is empty' END, CASE WHEN h % 17 = 0 OR h % 19 = 0 THEN 'confidence is outside [0, 1]' END, CASE WHEN h % 23 = 0 THEN 'polygon has fewer than 3 points' END, CASE WHEN h % 23 <> 0 AND h % 29 = 0 THEN 'polygon point is not a pair of numbers' END], lambda m: m IS NOT NULL)"


@query(f"SELECT ordinal::VARCHAR AS ordinal, {_ERRORS} AS errors FROM lines WHERE len({_ERRORS}) > 0")
def contract_errors(spark, sf_dir):
    return contract.split_valid(contract.with_errors(_broken(spark, sf_dir)))[1].select(F.col("ordinal").cast("string").alias("ordinal"), "errors")


@query(f"SELECT coalesce({_ERRORS}[1], 'valid') AS error, count(*) AS n FROM lines GROUP BY 1")
def contract_summary(spark, sf_dir):
    return contract.error_summary(contract.with_errors(_broken(spark, sf_dir)))


@query(f"SELECT manuscript || '_' || doc_id AS image_id, line_id, prediction AS transcription, confidence, (length(trim(prediction, {_WHITE_SQL})) < 5 OR confidence < 0.6 OR (regexp_matches(text, '{MARKS_SQL}') AND confidence < 0.72)) AS needs_review, 'segmentations/' || doc_id || '.xml' AS page_xml_ref FROM lines")
def deliverables(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("source", F.col("doc_id").cast("string"))
    preds = lines.select("ordinal", F.col("prediction").alias("text"), "confidence", F.lit(None).cast("array<array<double>>").alias("polygon"), F.lit(None).cast("string").alias("second"))
    ok, _ = contract.split_valid(contract.deliverables(lines, preds))
    return ok.select("image_id", "line_id", "transcription", "confidence", "needs_review", "page_xml_ref")


@query()
def nw_align(spark, sf_dir):
    a = align.aligned(F.col("prediction"), F.col("reference"))
    return _lines(spark, sf_dir).withColumn("x", a).select("line_id", F.col("x.a").alias("aligned_prediction"), F.col("x.b").alias("aligned_reference"))


@query()
def fuse(spark, sf_dir):
    f = align.fused(F.col("prediction"), F.col("confidence"), F.col("prediction2"), 1 - F.col("confidence"))
    return _lines(spark, sf_dir).withColumn("x", f).select("line_id", F.col("x.text").alias("fused"), F.col("x.confidence").alias("confidence"))


# Splits and hashes.

_U = "('0x' || substr(md5(manuscript || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_SPLIT_SQL = f"CASE WHEN {_U} < 0.15 THEN 'test' WHEN {_U} < 0.15::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'train' END"


@query(f"SELECT {_SPLIT_SQL} AS split, count(DISTINCT manuscript) AS manuscripts, count(*) AS lines, avg(has_abbreviation::INT) AS rate FROM lines GROUP BY 1")
def split_by_hash(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("split", split.split_of(F.col("manuscript")))
    return rows.groupBy("split").agg(F.countDistinct("manuscript").alias("manuscripts"), F.count(F.lit(1)).alias("lines"), F.avg(F.col("has_abbreviation").cast("double")).alias("rate"))


@query(f"SELECT image_id FROM (SELECT *, {_SPLIT_SQL} AS split FROM lines) WHERE split = 'train' INTERSECT SELECT image_id FROM (SELECT *, {_SPLIT_SQL} AS split FROM lines) WHERE split = 'test'")
def leak_check(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("split", split.split_of(F.col("manuscript")))
    return contract.leaks(rows.where("split = 'train'"), rows.where("split = 'test'"))


@query("SELECT source AS manuscript, sha256(string_agg(doc_id || sha256(text), '' ORDER BY source || '/' || doc_id)) AS sha256, count(*) AS files FROM documents GROUP BY source", lines=False)
def sha_split(spark, sf_dir):
    docs = testbed.table(spark, sf_dir, "documents").select(F.col("source").alias("manuscript"), F.concat_ws("/", "source", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return split.folder_hash(split.with_file_hash(docs), "manuscript")


# Entities.

_KIND = "CASE {h} % 4 WHEN 0 THEN 'LOC' WHEN 1 THEN 'MISC' WHEN 2 THEN 'ORG' ELSE 'PER' END"
_GAZETTEER_VIEWS = f"""
low AS (SELECT ordinal, manuscript, unnest({_T('text')}) AS word FROM lines),
forms AS (SELECT DISTINCT lower(word) AS form FROM low WHERE length(word) > 2 AND regexp_matches(word, '^\\p{{Lu}}')),
gazetteer AS (SELECT form, {_KIND.format(h="(('0x' || substr(md5(form), 9, 8))::BIGINT)")} AS type FROM forms),
entities AS (SELECT ordinal, string_split(manuscript, '_')[1] AS manuscript, word, type FROM low JOIN gazetteer ON lower(word) = form WHERE length(word) > 2 AND lower(word) NOT IN ({", ".join(map(_q, ner.STOP_WORDS))}))
"""


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms that are written with a capital somewhere, as known names."""
    forms = _lines(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("word")).where((F.length("word") > 2) & F.col("word").rlike(r"^\p{Lu}")).select(F.lower("word").alias("form")).distinct()
    kind = F.conv(F.substring(F.md5("form"), 9, 8), 16, 10).cast("long") % 4
    return forms.withColumn("type", F.element_at(F.array(*map(F.lit, ner.TYPES)), (kind + 1).cast("int")))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.annotate_by_gazetteer(_lines(spark, sf_dir), _gazetteer(spark, sf_dir))


@query("SELECT ordinal::VARCHAR AS ordinal, manuscript, word, type FROM entities", _GAZETTEER_VIEWS)
def ner_gazetteer(spark, sf_dir):
    return _entities(spark, sf_dir).drop("at").withColumn("ordinal", F.col("ordinal").cast("string"))


@query("SELECT t.type, count(word) AS total, count(DISTINCT lower(word)) AS distinct_forms FROM (VALUES ('LOC'), ('MISC'), ('ORG'), ('PER')) t(type) LEFT JOIN entities e ON e.type = t.type GROUP BY t.type", _GAZETTEER_VIEWS)
def ner_by_type(spark, sf_dir):
    return ner.entities_by_type(_entities(spark, sf_dir))


@query("SELECT manuscript, " + ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS \"{t}\"" for t in ner.TYPES) + " FROM entities GROUP BY manuscript", _GAZETTEER_VIEWS)
def ner_by_ms_pivot(spark, sf_dir):
    return ner.entities_by_manuscript(_entities(spark, sf_dir))


@query("SELECT type, form, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, first, form) AS rank FROM (SELECT type, lower(word) AS form, count(*) AS n, min(ordinal) AS first FROM entities GROUP BY ALL)) WHERE rank <= 20", _GAZETTEER_VIEWS)
def ner_top20(spark, sf_dir):
    return ner.top_entities(_entities(spark, sf_dir))


# Layout and journal.

_BOX = lambda c, k, f: f"(({c} // {k}) % {f})"
_RECT_VIEW = f"""
boxes AS (SELECT line_id, h, {_BOX('h', 1, 400)} AS ax, {_BOX('h', 7, 400)} AS ay, 50 + {_BOX('h', 11, 300)} AS aw, 20 + {_BOX('h', 13, 200)} AS ah, {_BOX('h', 17, 60)} AS dx, {_BOX('h', 19, 40)} AS dy FROM lines),
cross_boxes AS (SELECT *, greatest(aw - dx + 1, 0) * greatest(ah - dy + 1, 0) AS common FROM boxes),
ious AS (SELECT line_id, common / (2 * (aw + 1) * (ah + 1) - common) AS iou FROM cross_boxes)
"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k, n: (F.floor(F.col("h") / k) % n)
    x, y, w, h, dx, dy = at(1, 400), at(7, 400), 50 + at(11, 300), 20 + at(13, 200), at(17, 60), at(19, 40)
    return _lines(spark, sf_dir).select("line_id", layout.rectangle_iou([x, y, x + w, y + h], [x + dx, y + dy, x + dx + w, y + dy + h]).alias("iou"))


@query("SELECT line_id, iou FROM ious", _RECT_VIEW)
def iou_rect(spark, sf_dir):
    return _boxes(spark, sf_dir)


@query("SELECT count(iou) AS pairs, avg(iou) AS mean_iou, min(iou) AS min_iou, max(iou) AS max_iou, avg((iou >= 0.75)::INT) AS share_75, avg((iou >= 0.85)::INT) AS share_85 FROM ious", _RECT_VIEW)
def iou_summary(spark, sf_dir):
    return layout.iou_summary(_boxes(spark, sf_dir))


#: Invented error rates of training runs by epoch.
RUNS = {"run1": (0.9, 0.7, 0.6, 0.55, 0.5, 0.45, 0.46), "run2": (0.40, 0.35, 0.36, 0.35, 0.37, 0.20), "run3": (0.5, 0.5, 0.5, 0.5)}
_RUN_ROWS = [(r, i + 1, x) for r, xs in RUNS.items() for i, x in enumerate(xs)]


@query(
    """SELECT run, min(metric) AS best, max(epoch) AS stopped FROM f JOIN (SELECT run, coalesce(min(epoch) FILTER (WHERE since >= 3), max(epoch)) AS stop FROM f GROUP BY run) USING (run) WHERE epoch <= stop GROUP BY run""",
    f"""log AS (SELECT * FROM (VALUES {', '.join(f"('{r}', {i}, {x}::DOUBLE)" for r, i, x in _RUN_ROWS)}) t(run, epoch, metric)),
    b AS (SELECT *, metric < coalesce(min(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e308) AS better FROM log),
    f AS (SELECT *, epoch - coalesce(max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch), 0) AS since FROM b)""",
    lines=False,
)
def early_stop(spark, sf_dir):
    return split.early_stop(spark.createDataFrame(_RUN_ROWS, "run string, epoch int, metric double"))


# Sources and manifests.

_CLEAN_XML = "trim(regexp_replace(prediction, '[\\x{{0}}-\\x{{1F}}\\x{{FFFE}}\\x{{FFFF}}]', ' ', 'g'), ' ')".replace("{{", "{").replace("}}", "}")
_PAGES_VIEW = f"""
pages_text AS (SELECT *, {_CLEAN_XML} AS clean FROM lines),
numbered_lines AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ordinal) - 1 AS nr FROM pages_text WHERE clean <> '')
"""


def _xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): one layout file an image, with a box of each line."""
    text = F.btrim(F.regexp_replace("prediction", r"[\x00-\x1F\uFFFE\uFFFF]", " "))
    escaped = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    at = lambda k, n: F.floor(F.col("h") / k) % n
    line = F.format_string('<TextLine ID="%s" HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d"><String CONTENT="%s"/></TextLine>', "line_id", at(1, 900) - 50, at(7, 900) - 50, at(11, 300), at(13, 60), escaped)
    rows = _lines(spark, sf_dir).select("image_id", "manuscript", F.struct("ordinal", line.alias("x")).alias("l"))
    # A page is one file.
    pages = rows.groupBy("image_id", "manuscript").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda l: l["x"]), "").alias("body"))
    content = F.concat(F.lit(f'<alto xmlns="{sources.ALTO}"><Layout><Page>'), "body", F.lit("</Page></Layout></alto>"))
    return pages.select(F.concat(F.lit("/"), "manuscript", F.lit("/"), "image_id", F.lit(".xml")).alias("path"), F.encode(content, "UTF-8").alias("content"))


@query("SELECT manuscript, image_id || '.xml' AS source_xml, nr AS line_no, clean AS text FROM numbered_lines", _PAGES_VIEW)
def xml_texts(spark, sf_dir):
    return sources.lines_of_xml(_xml_files(spark, sf_dir))


_BOXES_VIEW = """
raw_boxes AS (SELECT *, (h // 1) % 900 - 50 AS x, (h // 7) % 900 - 50 AS y, (h // 11) % 300 AS w, (h // 13) % 60 AS hh FROM pages_text),
clipped AS (SELECT *, greatest(0, x) AS x1, greatest(0, y) AS y1, least(800, x + w) AS x2, least(600, y + hh) AS y2 FROM raw_boxes WHERE clean <> '' AND w > 0 AND hh > 0)
"""


@query("SELECT line_id, clean AS text, x1, y1, x2, y2 FROM clipped WHERE x2 > x1 AND y2 > y1", f"{_PAGES_VIEW.strip()}, {_BOXES_VIEW.strip()}")
def xml_crops(spark, sf_dir):
    files = _xml_files(spark, sf_dir)
    sizes = files.select(sources.folder_of(F.col("path")).alias("manuscript"), sources.stem_of(F.col("path")).alias("stem"), F.lit(800).alias("width"), F.lit(600).alias("height"))
    return sources.crops_of_xml(files, sizes).select("line_id", "text", "x1", "y1", "x2", "y2")


@query("SELECT image_id, nr AS ordinal, CASE WHEN h % 5 = 0 THEN printf('line_%04d', nr) ELSE line_id END AS line_id, prediction AS transcription, confidence, has_abbreviation FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ordinal) - 1 AS nr FROM lines)")
def json_array_lines(spark, sf_dir):
    """The lines of each image as one JSON array, some without an id, read back."""
    fields = [F.when(F.col("h") % 5 != 0, F.col("line_id")).alias("line_id"), F.col("prediction").alias("transcription"), "confidence", "has_abbreviation", F.lit(1).alias("extra")]
    rows = _lines(spark, sf_dir).select("image_id", F.struct("ordinal", F.struct(*fields).alias("x")).alias("l"))
    texts = rows.groupBy("image_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list("l")), lambda l: l["x"])).alias("value"))
    return sources.lines_of_json(texts, "value", "line_id string, transcription string, confidence double, has_abbreviation boolean")


@query(f"SELECT line_id, transcription, len(errors) AS errors FROM (SELECT line_id, prediction AS transcription, {_ERRORS} AS errors FROM padded)", _PADDED_VIEW)
def contract_json(spark, sf_dir):
    """Deliverable lines as JSON text, parsed and checked."""
    raw = _broken(spark, sf_dir).select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))
    return contract.parse(raw).select("line_id", "transcription", F.size("errors").cast("long").alias("errors"))


_SPLIT_LINES = f"split_lines AS (SELECT *, {_SPLIT_SQL} AS split FROM lines)"


@query("SELECT split, line_id, text, has_abbreviation FROM (SELECT split, line_id, reference AS text, has_abbreviation, row_number() OVER (PARTITION BY split ORDER BY manuscript, doc_id, line_no) AS nth FROM split_lines) WHERE nth <= 100", _SPLIT_LINES)
def manifest_first100(spark, sf_dir):
    rows = _referenced(spark, sf_dir).select("manuscript", F.col("doc_id").alias("source_xml"), "line_no", "line_id", "text")
    splits = rows.select("manuscript", split.split_of(F.col("manuscript")).alias("split"))
    return dataset.manifest(rows, splits, limit=100).select("split", "line_id", "text", "has_abbreviation")


@query("SELECT split, count(*) AS lines, count(*) FILTER (WHERE has_abbreviation) AS abbreviated, avg(has_abbreviation::INT) AS rate FROM split_lines GROUP BY split", _SPLIT_LINES)
def manifest_rates(spark, sf_dir):
    rows = _referenced(spark, sf_dir).select("manuscript", F.col("doc_id").alias("source_xml"), "line_no", "line_id", "text")
    return dataset.manifest_rates(dataset.manifest(rows, rows.select("manuscript", split.split_of(F.col("manuscript")).alias("split"))))


# Characters of no width, several sources, a fallback.


@query(f"SELECT line_id, {_normal_sql('marked', 'diplomatic')} AS clean FROM (SELECT line_id, left(reference, 1) || chr(65279) || substr(reference, 2) || chr(8203) AS marked FROM lines)")
def norm_zero_width(spark, sf_dir):
    marked = F.concat(F.left("reference", F.lit(1)), F.lit("\ufeff"), F.col("reference").substr(F.lit(2), F.length("reference")), F.lit("\u200b"))
    return _lines(spark, sf_dir).select("line_id", N.normalize_text(marked).alias("clean"))


_TWO_VIEW = f"""
two_tokens AS (SELECT lower(unnest({_TOKENS.format(x='clean_p')})) AS form, string_split(manuscript, '_')[1] AS manuscript, has_abbreviation, 0 AS source, ordinal FROM clean
  UNION ALL SELECT lower(unnest({_TOKENS.format(x='clean_r')})), string_split(manuscript, '_')[1], has_abbreviation, 1, ordinal FROM clean)
"""


@query("SELECT form, count(*) AS freq, list_sort(list(DISTINCT manuscript)) AS manuscripts, count(*) = 1 AS hapax FROM two_tokens GROUP BY form", f"{_CLEAN_VIEW}, {_TWO_VIEW.strip()}")
def lexicon_two_sources(spark, sf_dir):
    clean = lambda c: _lines(spark, sf_dir).withColumn("clean", N.normalize_text(F.col(c)))
    return lexicon.lexicon(clean("prediction"), clean("reference")).select("form", "freq", "manuscripts", "hapax")


@query("SELECT form FROM dict UNION SELECT * FROM (VALUES ('sire'), ('damoisele'), ('palefroi')) t(form)", f"{_CLEAN_VIEW}, {_DICT_VIEW}")
def dict_with_fallback(spark, sf_dir):
    listed = spark.createDataFrame([("sire",), ("damoisele",), ("palefroi",)], "form string")
    return lexicon.dictionary_from_lines(_referenced(spark, sf_dir), listed)


# A model's entities, and polygons.


def _capitals():
    """Stands for an entity model: words with a capital, types and scores by their length."""
    import re

    def find(text: str) -> list[dict]:
        return [{"entity_group": f"B-{ner.TYPES[len(m[0]) % 4]}", "word": f" {m[0]}\t", "score": 0.65 + len(m[0]) % 4 / 10, "start": m.start(), "end": m.end()} for m in re.finditer("[A-Z][a-z]+", text)]

    return find


_CAPITALS_VIEW = f"capitals AS (SELECT line_id, string_split(manuscript, '_')[1] AS manuscript, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS word FROM lines), model AS (SELECT line_id, manuscript, word, {_KIND.format(h='length(word)')} AS type, 0.65 + length(word) % 4 / 10.0 AS score FROM capitals WHERE length(word) > 2 AND length(word) % 4 > 1 AND lower(word) NOT IN ({', '.join(map(_q, ner.STOP_WORDS))}))"


def _model_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ner.annotate(_lines(spark, sf_dir), _capitals)
    return lines.select("line_id", T.manuscript_of(F.col("manuscript")).alias("manuscript"), F.explode("entities").alias("e")).select("line_id", "manuscript", "e.word", "e.type", F.round("e.score", 4).alias("score"))


@query("SELECT line_id, manuscript, word, type, score::DOUBLE AS score FROM model", _CAPITALS_VIEW)
def ner_model(spark, sf_dir):
    return _model_entities(spark, sf_dir)


@query("SELECT l.line_id, count(m.word) AS n FROM lines l LEFT JOIN model m USING (line_id) GROUP BY l.line_id", _CAPITALS_VIEW)
def ner_model_lines(spark, sf_dir):
    return ner.annotate(_lines(spark, sf_dir), _capitals).select("line_id", F.size("entities").cast("long").alias("n"))


_POLYGON_VIEW = f"""
squares AS (SELECT line_id, {_BOX('h', 1, 12)} AS ax, {_BOX('h', 7, 12)} AS ay, 2 + {_BOX('h', 11, 8)} AS aw, 2 + {_BOX('h', 13, 8)} AS ah, {_BOX('h', 17, 6)} AS dx, {_BOX('h', 19, 6)} AS dy FROM lines),
shared AS (SELECT *, greatest(aw - dx + 1, 0) * greatest(ah - dy + 1, 0) AS common FROM squares)
"""


@query("SELECT line_id, common / (2 * (aw + 1) * (ah + 1) - common) AS iou FROM shared", _POLYGON_VIEW)
def iou_polygon(spark, sf_dir):
    at = lambda k, n: F.floor(F.col("h") / k) % n
    x, y, w, h, dx, dy = at(1, 12), at(7, 12), 2 + at(11, 8), 2 + at(13, 8), at(17, 6), at(19, 6)
    corners = lambda x, y: F.array(*[F.array(a.cast("double"), b.cast("double")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])
    return _lines(spark, sf_dir).select("line_id", layout.polygon_iou(corners(x, y), corners(x + dx, y + dy), 32, 32).alias("iou"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
