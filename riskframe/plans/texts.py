"""Text cleaning, tokens, text statistics, vocabulary and bag of words."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import stats, text, tokens
from riskframe.functions.wordlists import CLOSED_CLASS_TAGS, STOP_WORDS, SUFFIX_TAGS, TAG_CLASSES
from riskframe.operators import lexicon, splits, vocab
from riskframe.plans.registry import query
from riskframe.plans.tables import SQL_PARTS, dealt, documents, table, targets
from riskframe.session import checkpointed

# --- SQL building blocks ----------------------------------------------------------


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(sql_text(v) for v in values)


SQL_SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
SQL_STOP = sql_list(STOP_WORDS)


def sql_words(c: str) -> str:
    return f"regexp_extract_all({c}, '[^{SQL_SPACE}]+')"


def sql_normalized(c: str) -> str:
    c = f"lower(strip_accents({c}))"
    c = f"regexp_replace({c}, '(do|ca|would|could|should|were|had|was|did|does|have|is|has)n''t', '\\1 not', 'g')"
    c = f"replace(replace({c}, '<br>', ' '), '<br/>', ' ')"
    c = f"regexp_replace({c}, '([,;.:!?])', ' \\1 ', 'g')"
    c = f"replace(replace({c}, chr(10), ' '), chr(9), ' ')"
    c = f"regexp_replace({c}, '\\p{{Nd}}', 'd', 'g')"
    c = f"regexp_replace({c}, ' +', ' ', 'g')"
    return f"lower(regexp_replace({c}, '^[{SQL_SPACE}]+|[{SQL_SPACE}]+$', '', 'g'))"


def sql_tokens(c: str) -> str:
    """The word separation rules, stated again for DuckDB."""
    c = f"' ' || {c} || ' '"
    for pattern, replacement in (
        (r'([ (\[{<])"', r"\1 `` "),
        (r'"', " '' "),
        (r"([\]\[(){}<>;@#$%&?!])", r" \1 "),
        ("--", " -- "),
        (r"([^'])' ", r"\1 ' "),
        (r"([^' ])('[sSmMdD]) ", r"\1 \2 "),
        (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
        (" ", "  "),
        (r"(?i) (can)(not) ", r" \1 \2 "),
        (r"(?i) (gim|lem)(me) ", r" \1 \2 "),
        (r"(?i) (gon|wan)(na) ", r" \1 \2 "),
        (r"(?i) (got)(ta) ", r" \1 \2 "),
    ):
        c = f"regexp_replace({c}, {sql_text(pattern)}, {sql_text(replacement)}, 'g')"
    return sql_words(c)


def sql_kept_tokens(c: str) -> str:
    """Normalised, lower-cased tokens without stop words and short ones."""
    return (
        f"list_filter({sql_tokens(sql_normalized(c))}, "
        f"lambda x: x NOT IN ({SQL_STOP}) AND length(x) >= 3)"
    )


def sql_stems(source: str) -> str:
    """CTEs from ``source(token)`` to ``stems(token, stem)``: Porter's steps one by one."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    m0, m1 = f"^({c})?{v}{c}", f"^({c})?{v}{c}{v}{c}"
    exactly_1 = f"^({c})?{v}{c}({v})?$"
    short = f"(regexp_matches(st, '^{c}[aeiouy][^aeiouwxy]$') OR regexp_matches(st, '^[aeiou][^aeiou]$'))"
    doubles = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

    def cut(n: int, w: str = "w") -> str:
        return f"left({w}, length({w}) - {n})"

    def swap(pairs: dict[str, str], condition: str) -> str:
        cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items())
        return f"""regexp_extract(w, '({'|'.join(pairs)})$', 1) AS su, left(w, length(w) - length(su)) AS st,
          CASE WHEN su <> '' AND regexp_matches(st, '{condition}') THEN st || (CASE su {cases} END) ELSE w END AS w2"""

    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tokens.IRREGULAR_STEMS.items())
    step_4 = "|".join(tokens.STEP_4)
    steps = [
        f"""CASE WHEN NOT ends_with(w, 's') THEN w WHEN ends_with(w, 'sses') THEN {cut(2)}
          WHEN ends_with(w, 'ies') THEN (CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END)
          WHEN ends_with(w, 'ss') THEN w ELSE {cut(1)} END AS w2""",
        f"""regexp_extract(w, '^(.*)(ed|ing)$', 1) AS st,
          CASE WHEN ends_with(w, 'ied') THEN (CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END)
          WHEN ends_with(w, 'eed') THEN (CASE WHEN regexp_matches({cut(3)}, '{m0}') THEN {cut(1)} ELSE w END)
          WHEN (ends_with(w, 'ed') OR ends_with(w, 'ing')) AND regexp_matches(st, '^({c})?[aeiouy]') THEN
            (CASE WHEN regexp_matches(st, '(at|bl|iz)$') THEN st || 'e'
             WHEN regexp_matches(st, '{doubles}') THEN {cut(1, 'st')}
             WHEN {short} THEN st || 'e' ELSE st END)
          ELSE w END AS w2""",
        "regexp_replace(w, '^(.+[^aeiou])y$', '\\1i') AS w2",
        f"CASE WHEN ends_with(w, 'alli') AND regexp_matches({cut(4)}, '{m0}') THEN {cut(2)} ELSE w END AS w2",
        f"CASE WHEN ends_with(w, 'logi') AND regexp_matches({cut(3)}, '{m0}') THEN {cut(1)} || '|' ELSE w END AS w2",
        swap(tokens.STEP_2, m0),
        "replace(w, '|', '') AS w2",
        swap(tokens.STEP_3, m0),
        f"""regexp_extract(w, '({step_4})$', 1) AS su, left(w, length(w) - length(su)) AS st,
          CASE WHEN su <> '' AND regexp_matches(st, '{m1}') AND (su <> 'ion' OR regexp_matches(st, '[st]$'))
          THEN st ELSE w END AS w2""",
        f"""{cut(1)} AS st, CASE WHEN ends_with(w, 'e') AND (regexp_matches(st, '{m1}')
          OR (regexp_matches(st, '{exactly_1}') AND NOT {short})) THEN st ELSE w END AS w2""",
        f"CASE WHEN ends_with(w, 'll') AND regexp_matches({cut(1)}, '{m1}') THEN {cut(1)} ELSE w END AS w2",
    ]
    ctes = [
        f"""s0 AS (SELECT token, CASE WHEN length(token) <= 2 THEN token ELSE
          (CASE token {irregular} END) END AS fixed, regexp_replace(lower(token), '^y', 'Y') AS w FROM {source})"""
    ]
    for i, step in enumerate(steps):
        ctes.append(
            f"s{i + 1} AS (SELECT token, fixed, w2 AS w FROM (SELECT token, fixed, w, {step} FROM s{i}))"
        )
    ctes.append(
        f"stems AS (SELECT token, coalesce(fixed, lower(w)) AS stem FROM s{len(steps)})"
    )
    return ",\n".join(ctes)


def sql_tag(w: str) -> str:
    cases = " ".join(
        f"WHEN lower({w}) IN ({sql_list(members.split())}) THEN '{name}'"
        for name, members in CLOSED_CLASS_TAGS.items()
    )
    endings = " ".join(
        f"WHEN ends_with(lower({w}), '{e}') AND length({w}) > {len(e) + 1} THEN '{name}'"
        for e, name in SUFFIX_TAGS
    )
    return (
        f"CASE {cases} WHEN NOT regexp_matches({w}, '[\\p{{L}}\\p{{N}}]') THEN '.' "
        f"WHEN regexp_matches({w}, '^[\\p{{Nd}}.,/-]+$') THEN 'CD' {endings} ELSE 'NN' END"
    )


def _sql_rule(kind: str, ending: str, instead: str) -> str:
    return (
        f"SELECT token, '{kind}' AS class, left(token, length(token) - {len(ending)}) || '{instead}' AS lemma "
        f"FROM vocabulary WHERE ends_with(token, '{ending}') AND length(token) > {len(ending) + 1}"
    )


def sql_lemmas(words: str) -> str:
    """CTEs ``vocabulary(token)``, ``candidates`` and ``lemmas(token, class, lemma)`` from a query of the words."""
    return f"""vocabulary AS ({words}),
candidates AS ({' UNION '.join(_sql_rule(kind, *rule) for kind, rule in lexicon.DETACHMENT_RULES)}),
lemmas AS (
  SELECT token, class, lemma FROM candidates WHERE lemma IN (SELECT token FROM vocabulary)
  QUALIFY row_number() OVER (PARTITION BY token, class ORDER BY length(lemma) DESC, lemma DESC) = 1)"""


def sql_class(w: str) -> str:
    return f"CASE WHEN ({sql_tag(w)}) IN ({sql_list(TAG_CLASSES['verb'])}) THEN 'verb' ELSE 'noun' END"


# --- Normalisation ----------------------------------------------------------------


@query("strip_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query(
    "expand_contractions",
    """
    WITH t AS (
      SELECT doc_id, 'i don''t, can''t, wouldn''t, couldn''t, shouldn''t, weren''t, hadn''t, wasn''t, didn''t, '
        || 'doesn''t, haven''t, isn''t, hasn''t, won''t ' || text AS c FROM documents)
    SELECT doc_id, regexp_replace(c, '(do|ca|would|could|should|were|had|was|did|does|have|is|has)n''t', '\\1 not', 'g')
      AS expanded FROM t
    """,
)
def _(spark, folder):
    forms = (
        "i don't, can't, wouldn't, couldn't, shouldn't, weren't, hadn't, wasn't, didn't, "
        "doesn't, haven't, isn't, hasn't, won't "
    )
    prefixed = F.concat(F.lit(forms), "text")
    return documents(spark, folder).select("doc_id", text.expand_contractions(prefixed).alias("expanded"))


@query(
    "strip_br",
    "SELECT page_id, replace(replace(html, '<br>', ' '), '<br/>', ' ') AS html FROM pages",
)
def _(spark, folder):
    pages = dealt(table(spark, folder, "pages"), "page_id")
    return pages.select("page_id", text.strip_br(F.col("html")).alias("html"))


@query(
    "pad_punctuation",
    "SELECT doc_id, regexp_replace(text, '([,;.:!?])', ' \\1 ', 'g') AS padded FROM documents",
)
def _(spark, folder):
    return documents(spark, folder).select("doc_id", text.pad_punctuation(F.col("text")).alias("padded"))


@query(
    "mask_digits",
    "SELECT doc_id, regexp_replace(text, '\\p{Nd}', 'd', 'g') AS masked FROM documents",
)
def _(spark, folder):
    return documents(spark, folder).select("doc_id", text.mask_digits(F.col("text")).alias("masked"))


@query("normalize_text", f"SELECT doc_id, {sql_normalized('text')} AS normalized FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


# --- Tokens -----------------------------------------------------------------------

SQL_TOKENS = f"toks AS (SELECT doc_id, {sql_kept_tokens('text')} AS tokens FROM documents)"
SQL_CLEAN = f"""{SQL_TOKENS},
occurrences AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM toks),
distinct_tokens AS (SELECT DISTINCT token FROM occurrences),
{sql_stems('distinct_tokens')},
{sql_lemmas("SELECT DISTINCT stem AS token FROM stems")},
finished AS (
  SELECT token, coalesce(l.lemma, stem) AS word FROM (SELECT token, stem, {sql_class('stem')} AS class FROM stems) s
  LEFT JOIN (SELECT token AS stem, class, lemma FROM lemmas) l USING (stem, class)),
cleaned AS (
  SELECT t.doc_id, coalesce(string_agg(f.word, ' ' ORDER BY o.pos), '') AS clean_text
  FROM toks t LEFT JOIN occurrences o USING (doc_id) LEFT JOIN finished f USING (token) GROUP BY t.doc_id)"""


def kept_tokens(spark, folder):
    """``(doc_id, tokens)``: normalised tokens without stop words and short ones."""
    return documents(spark, folder).select(
        "doc_id", tokens.clean_tokens(F.col("text"), stem=False).alias("tokens")
    )


def stemmed(spark, folder):
    """``(doc_id, stems)``: the stems of all texts."""
    return documents(spark, folder).select("doc_id", tokens.clean_tokens(F.col("text")).alias("stems"))


@query(
    "tokenize",
    f"SELECT doc_id, array_to_string({sql_tokens(sql_normalized('text'))}, ' ') AS tokens FROM documents",
)
def _(spark, folder):
    found = tokens.lower_tokens(tokens.tokenize(text.normalize_text(F.col("text"))))
    return documents(spark, folder).select("doc_id", F.array_join(found, " ").alias("tokens"))


@query(
    "remove_stopwords",
    f"""SELECT doc_id, array_to_string(list_filter({sql_tokens(sql_normalized('text'))},
        lambda x: x NOT IN ({SQL_STOP})), ' ') AS tokens FROM documents""",
)
def _(spark, folder):
    found = tokens.remove_stopwords(tokens.tokenize(text.normalize_text(F.col("text"))))
    return documents(spark, folder).select("doc_id", F.array_join(found, " ").alias("tokens"))


@query(
    "remove_short_tokens",
    f"""SELECT doc_id, array_to_string(list_filter({sql_tokens(sql_normalized('text'))},
        lambda x: length(x) >= 3), ' ') AS tokens FROM documents""",
)
def _(spark, folder):
    found = tokens.remove_short(tokens.tokenize(text.normalize_text(F.col("text"))))
    return documents(spark, folder).select("doc_id", F.array_join(found, " ").alias("tokens"))


@query("stem_map", f"WITH {SQL_CLEAN} SELECT token, stem FROM stems")
def _(spark, folder):
    return lexicon.stem_map(kept_tokens(spark, folder), "tokens")


@query(
    "tag_tokens",
    f"WITH {SQL_TOKENS} SELECT DISTINCT token, {sql_tag('token')} AS tag "
    "FROM (SELECT unnest(tokens) AS token FROM toks)",
)
def _(spark, folder):
    return lexicon.tag_map(kept_tokens(spark, folder), "tokens")


@query(
    "rewrite_tokens",
    f"""
    WITH {SQL_TOKENS},
    occurrences AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM toks),
    {sql_lemmas("SELECT DISTINCT token FROM occurrences")},
    tagged AS (SELECT *, {sql_class('token')} AS class FROM occurrences)
    SELECT t.doc_id, coalesce(string_agg(coalesce(l.lemma, o.token), ' ' ORDER BY o.pos), '') AS lemmas
    FROM toks t LEFT JOIN tagged o USING (doc_id) LEFT JOIN lemmas l USING (token, class) GROUP BY t.doc_id
    """,
)
def _(spark, folder):
    kept = kept_tokens(spark, folder)
    lemmas = lexicon.lemma_lexicon(lexicon.known_words(kept, "tokens"))
    rewritten = lexicon.rewrite_tokens(kept, "doc_id", "tokens", lemmas)
    return rewritten.select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


@query("clean_text", f"WITH {SQL_CLEAN} SELECT doc_id, clean_text FROM cleaned")
def _(spark, folder):
    return lexicon.clean_texts(documents(spark, folder).select("doc_id", "text"), "text")


@query(
    "text_preview",
    f"""
    WITH {SQL_CLEAN}
    SELECT doc_id, d.text, {sql_normalized('d.text')} AS normalized, clean_text
    FROM documents d JOIN cleaned USING (doc_id) ORDER BY doc_id LIMIT 20
    """,
)
def _(spark, folder):
    lemmas = lexicon.lemma_lexicon(lexicon.known_stems(kept_tokens(spark, folder), "tokens"))
    shown = text.preview(table(spark, folder, "documents"), "doc_id", "text", rows=20)
    cleaned = lexicon.clean_texts(shown, "text", lemmas, keep_source=True)
    return cleaned.select("doc_id", "text", "normalized", "clean_text")


# --- Statistics -------------------------------------------------------------------


def sql_stat(name: str, c: str) -> str:
    w = sql_words(c)
    upper = r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$"
    title = r"^[^\p{Lu}\p{Ll}\p{Lt}]*([\p{Lu}\p{Lt}]\p{Ll}*([^\p{Lu}\p{Ll}\p{Lt}]+|$))+$"
    punctuation = f"(length({c}) - length(regexp_replace({c}, '[!-/:-@\\[-`{{-~]', '', 'g')))"
    return {
        "word_count": f"len({w})::BIGINT",
        "unique_word_count": f"len(list_distinct({w}))::BIGINT",
        "char_count": f"length({c})::BIGINT",
        "punctuation_count": f"{punctuation}::BIGINT",
        "upper_word_count": f"len(list_filter({w}, lambda x: regexp_matches(x, '{upper}')))::BIGINT",
        "title_word_count": f"len(list_filter({w}, lambda x: regexp_matches(x, '{title}')))::BIGINT",
        "stopword_count": f"len(list_filter({w}, lambda x: lower(x) IN ({SQL_STOP})))::BIGINT",
        "mean_word_length": f"round(list_avg(list_transform({w}, lambda x: length(x))), 6)",
        "unique_word_percent": f"round(len(list_distinct({w})) * 100.0::DOUBLE / nullif(len({w}), 0), 6)",
        "punctuation_percent": f"round({punctuation} * 100.0::DOUBLE / nullif(len({w}), 0), 6)",
        "lexical_diversity": f"round(length({c})::DOUBLE / nullif(len(list_distinct(regexp_extract_all({c}, '(?s).'))), 0), 6)",
    }[name]


FLOATS = ("mean_word_length", "unique_word_percent", "punctuation_percent", "lexical_diversity")


def _register_stat(name: str) -> None:
    @query(name, f"SELECT doc_id, {sql_stat(name, 'text')} AS {name} FROM documents")
    def _(spark, folder):
        split = documents(spark, folder).select("doc_id", "text", text.words(F.col("text")).alias("w"))
        value = stats.pick(name, F.col("text"), F.col("w"))
        return split.select("doc_id", (F.round(value, 6) if name in FLOATS else value).alias(name))


for _name in stats.FEATURE_NAMES:
    _register_stat(_name)


def sql_stat_columns(column: str, feature: str | None = None) -> str:
    feature = feature or column
    return ", ".join(
        f"{sql_stat(name, column)} AS {out.format(feature)}" for name, out in stats.FEATURE_NAMES.items()
    )


def rounded(df):
    """The result with every double rounded to six decimals."""
    return df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "text_stats",
    f"""
    SELECT 'documents' AS source, doc_id AS id, {sql_stat_columns('text')} FROM documents
    UNION ALL
    SELECT 'part', p_partkey, {sql_stat_columns('p_name', 'text')} FROM part
    """,
)
def _(spark, folder):
    docs = documents(spark, folder).select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    parts = table(spark, folder, "part").select(
        F.lit("part").alias("source"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text")
    )
    counted = stats.with_text_stats(docs.unionByName(parts), ["text"])
    return rounded(counted.drop("text"))


SQL_POS_TOKENS = f"pos_toks AS (SELECT doc_id, {sql_tokens(chr(34) + 'padded' + chr(34))} AS tokens FROM (SELECT doc_id, regexp_replace(text, '([,;.:!?])', ' \\1 ', 'g') AS padded FROM documents))"
SQL_POS = f"""{SQL_POS_TOKENS},
pos_tags AS (SELECT doc_id, list_transform(tokens, lambda x: {sql_tag('x')}) AS tags FROM pos_toks),
pos AS (
  SELECT doc_id, {', '.join(f"len(list_filter(tags, lambda t: t IN ({sql_list(TAG_CLASSES[n])})))::BIGINT AS {n}_count" for n in TAG_CLASSES)}
  FROM pos_tags)"""


def tag_counts(df, column="text"):
    """The five part-of-speech counts of the raw text."""
    tags = tokens.tag_tokens(tokens.tokenize(text.pad_punctuation(F.coalesce(F.col(column), F.lit("m")))))
    tagged = df.withColumn("_tags", tags)
    return tagged.withColumns(
        {f"{n}_count": tokens.tag_class_count(F.col("_tags"), n) for n in TAG_CLASSES}
    ).drop("_tags")


@query("pos_counts", f"WITH {SQL_POS} SELECT * FROM pos")
def _(spark, folder):
    return tag_counts(documents(spark, folder).select("doc_id", "text")).drop("text")


@query(
    "text_features_all",
    f"""
    WITH {SQL_CLEAN}, {SQL_POS}
    SELECT doc_id, clean_text, {sql_stat_columns('text')}, {sql_stat_columns('source')}, pos.* EXCLUDE (doc_id)
    FROM documents JOIN cleaned USING (doc_id) JOIN pos USING (doc_id)
    """,
)
def _(spark, folder):
    return rounded(text_features(documents(spark, folder), ["text", "source"], "text").drop("source", "lang", "n_chars"))


def text_features(df, columns, notes):
    """Cleaned text, the statistics of ``columns`` and the tag counts of ``notes``, which goes."""
    return lexicon.clean_texts(tag_counts(stats.with_text_stats(df, columns), notes), notes)


@query(
    "mark_counts",
    f"""
    SELECT doc_id, len({sql_words('text')})::BIGINT AS num_words,
      (length(text) - length(replace(text, ',', '')))::BIGINT AS num_commas,
      (length(text) - length(replace(text, '!', '')))::BIGINT AS num_bangs,
      (length(text) - length(replace(replace(text, '"', ''), '''', '')))::BIGINT AS num_quotes,
      round(list_avg(list_transform({sql_words('text')}, lambda x: length(x))), 6) AS avg_word
    FROM documents
    """,
)
def _(spark, folder):
    counted = stats.mark_counts(documents(spark, folder).select("doc_id", "text"), "text")
    return rounded(counted.drop("text"))


# --- Vocabulary and bag of words ----------------------------------------------------


def bow_frame(spark, folder):
    """``(doc_id, terms)``: lower-cased words without stop words."""
    return documents(spark, folder).select("doc_id", vocab.bow_tokens(F.col("text")).alias("terms"))


def gram_frame(spark, folder):
    """``(doc_id, grams)``: the 1-, 2- and 3-grams of the words."""
    return vocab.with_ngrams(bow_frame(spark, folder), "terms", "grams").select("doc_id", "grams")


SQL_BOW = f"""bow AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x NOT IN ({SQL_STOP})) AS t
  FROM documents)"""
SQL_GRAMS = f"""{SQL_BOW},
grams AS (
  SELECT doc_id, unnest(t) AS term FROM bow
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM bow
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))
    FROM bow)"""


def sql_vocabulary(source: str, name: str, where: str = "df >= 5", limit: int = 10_000) -> str:
    return f"""
{name} AS (
  SELECT term, tf, df, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (
    SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM {source} GROUP BY term HAVING {where}
    ORDER BY tf DESC, term LIMIT {limit}))"""


@query("bow_tokens", f"WITH {SQL_BOW} SELECT doc_id, array_to_string(t, ' ') AS terms FROM bow")
def _(spark, folder):
    return bow_frame(spark, folder).select("doc_id", F.array_join("terms", " ").alias("terms"))


@query(
    "ngrams",
    f"WITH {SQL_GRAMS} SELECT doc_id, count(term) AS n_grams, count(DISTINCT term) AS n_distinct, "
    "min(term) AS first_gram, max(term) AS last_gram FROM documents LEFT JOIN grams USING (doc_id) GROUP BY doc_id",
)
def _(spark, folder):
    grams = F.col("grams")
    return gram_frame(spark, folder).select(
        "doc_id",
        F.size(grams).cast("long").alias("n_grams"),
        F.size(F.array_distinct(grams)).cast("long").alias("n_distinct"),
        F.array_min(grams).alias("first_gram"),
        F.array_max(grams).alias("last_gram"),
    )


@query(
    "vocab_min_df",
    f"WITH {SQL_GRAMS} SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM grams GROUP BY term "
    "HAVING df >= 5",
)
def _(spark, folder):
    return vocab.frequent_terms(bow_frame(spark, folder), "terms")


@query("vocab_topk", f"WITH {SQL_GRAMS}, {sql_vocabulary('grams', 'v')} SELECT * FROM v")
def _(spark, folder):
    return vocab.ngram_vocabulary(bow_frame(spark, folder), "terms")


@query(
    "vocab_train_val",
    f"""
    WITH {SQL_PARTS}, {SQL_GRAMS},
    fitted AS (SELECT * FROM grams WHERE doc_id IN (SELECT doc_id FROM parts WHERE part IN ('train', 'val'))),
    {sql_vocabulary('fitted', 'v')}
    SELECT * FROM v
    """,
)
def _(spark, folder):
    parts = splits.train_val_test_split(targets(spark, folder), "is_bad", "doc_id")
    fit_on = parts.filter(F.col("part").isin("train", "val"))
    return vocab.ngram_vocabulary(bow_frame(spark, folder).join(fit_on, "doc_id", "left_semi"), "terms")


SQL_BOW_COUNTS = f"""{SQL_GRAMS}, {sql_vocabulary('grams', 'v')},
bow_counts AS (SELECT doc_id, term_id, count(*) AS tf FROM grams JOIN v USING (term) GROUP BY doc_id, term_id)"""


@query("bow_counts", f"WITH {SQL_BOW_COUNTS} SELECT * FROM bow_counts")
def _(spark, folder):
    known = vocab.ngram_vocabulary(bow_frame(spark, folder), "terms")
    return vocab.bow_counts(bow_frame(spark, folder), "doc_id", "terms", known, high=3)


@query("bow_binary", f"WITH {SQL_BOW_COUNTS} SELECT doc_id, term_id, 1 AS present FROM bow_counts")
def _(spark, folder):
    known = vocab.ngram_vocabulary(bow_frame(spark, folder), "terms")
    return vocab.bow_binary(bow_frame(spark, folder), "doc_id", "terms", known, high=3)


def sql_tfidf(source: str, vocabulary: str, tf: str) -> str:
    return f"""
weights AS (
  SELECT doc_id, term, term_id, {tf} * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS weight
  FROM (SELECT doc_id, term, count(*) AS tf_ FROM {source} GROUP BY doc_id, term)
  JOIN {vocabulary} USING (term), (SELECT count(*) AS n FROM documents)),
tfidf AS (
  SELECT doc_id, term, term_id, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS tfidf FROM weights)"""


SQL_TFIDF = f"""{SQL_BOW},
terms AS (SELECT doc_id, unnest(t) AS term FROM bow),
{sql_vocabulary('terms', 'v', 'df >= 2 AND df <= 0.95::DOUBLE * (SELECT count(*) FROM documents)', 1000)},
{sql_tfidf('terms', 'v', 'tf_')}"""


def tfidf_words(spark, folder, n_features=1000):
    """The word weights topic models start from, and their vocabulary of at most ``n_features`` terms."""
    terms = bow_frame(spark, folder)
    known = checkpointed(vocab.vocabulary(terms, "terms", min_df=2, max_df=0.95, max_features=n_features))
    return vocab.tfidf(terms, "doc_id", "terms", known), known


@query("tfidf", f"WITH {SQL_TFIDF} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM tfidf")
def _(spark, folder):
    weights, _ = tfidf_words(spark, folder)
    return rounded(weights.drop("term_id"))


SQL_CHARS = f"""
chars AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(strip_accents(lower(text)), '[{SQL_SPACE}]{{2,}}', ' ', 'g'), '(?s).') AS c
  FROM documents),
grams AS ({' UNION ALL '.join(
    f"SELECT doc_id, unnest(list_transform(range(1, len(c) - {n - 2}), lambda i: "
    + " || ".join(f"c[i + {k}]" if k else "c[i]" for k in range(n)) + ")) AS term FROM chars" for n in range(2, 7))})"""


def char_block(spark, folder):
    """The weights of 2- to 6-character n-grams, and their vocabulary."""
    chars = documents(spark, folder).select("doc_id", vocab.char_terms(F.col("text")).alias("chars"))
    known = checkpointed(vocab.ngram_vocabulary(chars, "chars", 6, min_df=1, max_features=6000, low=2, separator=""))
    return vocab.tfidf(chars, "doc_id", "chars", known, sublinear=True, low=2, high=6, separator=""), known


@query(
    "char_ngrams",
    f"""
    WITH {SQL_CHARS}, {sql_vocabulary('grams', 'v', 'true', 6000)}, {sql_tfidf('grams', 'v', '(1 + ln(tf_))')}
    SELECT doc_id, count(*) AS n_terms, round(sum(tfidf), 4) AS weight_sum, round(max(tfidf), 6) AS weight_max
    FROM tfidf GROUP BY doc_id
    """,
)
def _(spark, folder):
    weights, _ = char_block(spark, folder)
    return weights.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"),
        F.round(F.sum("tfidf"), 4).alias("weight_sum"),
        F.round(F.max("tfidf"), 6).alias("weight_max"),
    )


SQL_CHAR_WORD = f"""
{SQL_GRAMS.replace('grams AS (', 'word_grams AS (')}, {sql_vocabulary('word_grams', 'word_v')},
bow_counts AS (SELECT doc_id, term_id FROM word_grams JOIN word_v USING (term) GROUP BY doc_id, term_id),
{SQL_CHARS}, {sql_vocabulary('grams', 'v', 'true', 6000)}, {sql_tfidf('grams', 'v', '(1 + ln(tf_))')},
cells AS (
  SELECT doc_id, 'char' AS block, term_id AS feature_id, tfidf AS value FROM tfidf
  UNION ALL SELECT doc_id, 'word', term_id + (SELECT count(*) FROM v), 1.0::DOUBLE FROM bow_counts)"""


@query(
    "char_word_features",
    f"""
    WITH {SQL_CHAR_WORD}
    SELECT doc_id, block, count(*) AS n_features, round(sum(value), 4) AS value_sum, min(feature_id) AS first_feature,
      max(feature_id) AS last_feature
    FROM cells GROUP BY doc_id, block
    """,
)
def _(spark, folder):
    # The word block stands right of the character block: 0/1 of the frequent 1- to 3-grams.
    weights, chars = char_block(spark, folder)
    known = checkpointed(vocab.ngram_vocabulary(bow_frame(spark, folder), "terms"))
    words = vocab.bow_binary(bow_frame(spark, folder), "doc_id", "terms", known, high=3)
    cells = vocab.stacked(
        "doc_id",
        [
            ("char", weights.withColumnRenamed("tfidf", "value"), chars),
            ("word", words.withColumnRenamed("present", "value"), known),
        ],
    )
    return cells.groupBy("doc_id", "block").agg(
        F.count("*").alias("n_features"),
        F.round(F.sum("value"), 4).alias("value_sum"),
        F.min("feature_id").alias("first_feature"),
        F.max("feature_id").alias("last_feature"),
    )
