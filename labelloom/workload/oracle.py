"""The queries as SQL over the same tables, written independently of the Spark
plans: plain cross joins and repeated texts, no tricks."""

from __future__ import annotations

from labelloom.functions import lexicons as L
from labelloom.operators.lemmas import NOUN_ENDINGS
from labelloom.workload import inputs as I

SQL: dict[str, str] = {}

WORD = r"[\p{L}\p{N}_]"
SPACE = r"\s\x0B\x1c-\x1f\x85\p{Z}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def values(rows) -> str:
    return "(VALUES " + ", ".join(
        "(" + ", ".join(q(v) if isinstance(v, str) else (f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)) for v in r) + ")"
        for r in rows
    ) + ")"


# --- text expressions ------------------------------------------------------

def normalize(e: str) -> str:
    for short, full in L.ABBREVIATIONS.items():
        p = rf"(?i)(^|[^\p{{L}}\p{{N}}_])({short})([^\p{{L}}\p{{N}}_]|$)"
        for _ in range(2):
            e = rf"regexp_replace({e}, {q(p)}, '\1{full}\3', 'g')"
    return e


def strip_urls(e: str) -> str:
    p = rf"http[^{SPACE}]+|www[^{SPACE}]+|[\p{{L}}\p{{N}}_.-]+@[\p{{L}}\p{{N}}_.-]+"
    return f"regexp_replace({e}, {q(p)}, '', 'g')"


def letters(e: str) -> str:
    return f"regexp_replace({e}, '[^a-zA-Z]+', ' ', 'g')"


def no_stop(e: str) -> str:
    return f"list_filter({e}, lambda x: x <> '' AND NOT list_contains({arr(L.STOP_WORDS)}, x))"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, {q('[' + SPACE + ']+')}), lambda x: x <> '')"


def clean(e: str) -> str:
    text = normalize(f"coalesce({e}, '')")
    tokens = f"string_split({letters(strip_urls(f'lower({text})'))}, ' ')"
    return f"array_to_string({no_stop(tokens)}, ' ')"


def ngrams(t: str, n: int) -> str:
    body = " || ' ' || ".join(f"{t}[i + {j}]" for j in range(n))
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: {body})"


def vtokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), {q(WORD + '{2,}')})"


def bar(e: str) -> str:
    return f"array_to_string({e}, '|')"


def key_terms(w: str, mode: str) -> str:
    longer = f"list_filter({w}, lambda x: length(x) > 3)"
    if mode == "basic":
        return f"list_concat({longer}, {ngrams(w, 2)}, {ngrams(w, 3)})"
    both = (
        f"list_transform(list_filter(range(1, len({w})), lambda i: length({w}[i]) > 3 AND length({w}[i + 1]) > 3), "
        f"lambda i: {w}[i] || ' ' || {w}[i + 1])"
    )
    return f"list_concat({longer}, {both})"


# --- tables ----------------------------------------------------------------

TAILED = (
    "SELECT doc_id AS company_id, text || " + arr(I.TAILS) + "[doc_id % 6 + 1] AS description, "
    "lang AS sector, source AS category FROM documents"
)
DOCS = f"SELECT doc_id AS company_id, {clean('text')} AS text FROM documents"
BENCH = f"SELECT item_id AS label_id, text AS label, {clean('text')} AS cleaned FROM benchmark"
TURNS = f"SELECT conv_id || '-' || turn AS company_id, {clean('text')} AS text FROM conversations"
PARTS = (
    "SELECT p_partkey AS company_id, p_name || ' ' || p_type AS description, p_type AS business_tags, "
    "p_brand AS category FROM part"
)
_part_words = clean("p_name || ' ' || p_type || ' ' || p_brand")
PART_TEXTS = f"SELECT p_partkey AS company_id, {_part_words} AS text FROM part"
PART_LABELS = (
    f"SELECT row_number() OVER (ORDER BY label) - 1 AS label_id, label, {clean('label')} AS cleaned "
    "FROM (SELECT DISTINCT p_name AS label FROM part)"
)
SYN = f"SELECT * FROM {values(I.SYNONYMS)} v(term, synset_rank, lemma_rank, lemma)"
CLASSIFIED = """
counts AS (SELECT o_custkey AS company_id, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL),
ranked AS (
  SELECT company_id, label, n::DOUBLE / sum(n) OVER (PARTITION BY company_id) AS score,
         row_number() OVER (PARTITION BY company_id ORDER BY n DESC, label) AS rank FROM counts),
lists AS (
  SELECT company_id, list(label ORDER BY rank) AS labels, list(score ORDER BY rank) AS scores
  FROM ranked GROUP BY company_id),
classified AS (
  SELECT c_custkey AS company_id, c_name, c_mktsegment, c_nationkey,
         coalesce(labels, []::VARCHAR[]) AS labels, coalesce(scores, []::DOUBLE[]) AS scores
  FROM customer LEFT JOIN lists ON c_custkey = company_id),
exploded AS (SELECT company_id, unnest(labels) AS label, unnest(scores) AS score FROM classified)
"""


def shown(key: str = "company_id", labels: str = "labels", scores: str = "scores") -> str:
    return (
        f"{key}, {bar(labels)} AS insurance_labels, "
        f"{bar(f'list_transform({scores}, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR))')} AS insurance_label_scores, "
        f"CASE WHEN len({labels}) > 0 THEN array_to_string({labels}, ', ') ELSE 'Unclassified' END AS insurance_label"
    )


# --- text ------------------------------------------------------------------

def title(e: str) -> str:
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({e}), '[{cased}]+|[^{cased}]+'), "
        "lambda p: CASE WHEN p[1] = 'ß' THEN 'Ss' ELSE upper(p[1]) END || p[2:]), '')"
    )


_suffix = "|".join(L.LEGAL_SUFFIXES)
_raw = f"trim(' ' || c_name || {arr(I.SUFFIX_NAMES)}[c_custkey % 17 + 1] || '  ')"
_bare = rf"trim(regexp_replace({_raw}, '\b({_suffix})\.?', '', 'g'))"
SQL["txt_clean_names"] = (
    rf"SELECT c_custkey, trim(regexp_replace(regexp_replace({title(_bare)}, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM customer"
)
SQL["txt_title_case"] = f"WITH d AS ({TAILED}) SELECT company_id, {title('description')} AS title FROM d"
SQL["txt_abbrev"] = f"WITH d AS ({TAILED}) SELECT company_id, {normalize('description')} AS text FROM d"
SQL["txt_clean_text"] = f"WITH d AS ({TAILED}) SELECT company_id, {clean('description')} AS text FROM d"

_steps = [f"s0 AS (SELECT company_id, lower({normalize('description')}) AS t FROM d)"]
for _i, _p in enumerate(L.PROTECTED_PHRASES):
    _steps.append(
        f"s{_i + 1} AS (SELECT company_id, CASE WHEN contains(lower(t), {q(_p)}) "
        f"THEN replace(lower(t), {q(_p)}, 'TERM_{_i}_PLACEHOLDER') ELSE t END AS t FROM s{_i})"
    )
SQL["txt_phrases"] = (
    f"WITH d AS ({TAILED}), " + ", ".join(_steps) + " SELECT company_id, array_to_string("
    + no_stop(f"string_split({letters(strip_urls('t'))}, ' ')")
    + f", ' ') AS text FROM s{len(L.PROTECTED_PHRASES)}"
)
SQL["txt_strip_urls"] = f"WITH d AS ({TAILED}) SELECT company_id, {strip_urls('description')} AS text FROM d"
SQL["txt_char_filter"] = f"WITH d AS ({TAILED}) SELECT company_id, {letters('description')} AS text FROM d"
SQL["txt_tokens"] = (
    f"WITH d AS ({TAILED}), t AS (SELECT company_id, {words('description')} AS w FROM d) "
    f"SELECT company_id, len(w) AS n, {bar('w')} AS tokens FROM t"
)
_kept = no_stop(words(f"lower({letters('description')})"))
SQL["txt_stopwords"] = f"WITH d AS ({TAILED}) SELECT company_id, array_to_string({_kept}, ' ') AS text FROM d"
SQL["txt_lemmatize"] = f"""
WITH d AS ({DOCS}),
lemmas AS (SELECT * FROM {values(I.LEMMAS)} v(surface, lemma)),
t AS (SELECT company_id, unnest(w) AS surface, generate_subscripts(w, 1) AS pos
      FROM (SELECT company_id, {words('text')} AS w FROM d)),
j AS (SELECT company_id, string_agg(coalesce(lemma, t.surface), ' ' ORDER BY pos) AS s
      FROM t LEFT JOIN lemmas ON t.surface = lemmas.surface GROUP BY company_id)
SELECT d.company_id, coalesce(s, '') AS combined_features FROM d LEFT JOIN j ON d.company_id = j.company_id
"""
SQL["txt_lemmatize_rules"] = f"""
WITH RECURSIVE d AS ({DOCS}), b AS ({BENCH}),
t AS (SELECT company_id, unnest(w) AS surface, generate_subscripts(w, 1) AS pos
      FROM (SELECT company_id, {words('text')} AS w FROM d)),
known AS (SELECT DISTINCT unnest({words('cleaned')}) AS form FROM b),
rules AS (SELECT * FROM {values([(i, *r) for i, r in enumerate(NOUN_ENDINGS)])} v(r, e, n)),
listed AS (SELECT * FROM {values(I.EXCEPTIONS)} v(surface, rank, lemma)),
s AS (SELECT DISTINCT surface FROM t),
c AS (
  SELECT surface, 0 AS level, [r + 1] AS place, left(surface, length(surface) - length(e)) || n AS form FROM s, rules WHERE ends_with(surface, e)
  UNION ALL
  SELECT surface, level + 1, place || [r], left(form, length(form) - length(e)) || n FROM c, rules WHERE ends_with(form, e)),
f AS (
  SELECT surface, level, place, form FROM c WHERE surface NOT IN (SELECT surface FROM listed)
  UNION ALL SELECT surface, 0, [0], surface FROM s
  UNION ALL SELECT surface, 0, [rank], lemma FROM s JOIN listed USING (surface)),
m AS (SELECT surface, arg_min(form, {{'l': level, 'n': length(form), 'p': place}}) AS lemma FROM f JOIN known USING (form) GROUP BY surface),
j AS (SELECT company_id, string_agg(coalesce(lemma, surface), ' ' ORDER BY pos) AS s FROM t LEFT JOIN m USING (surface) GROUP BY company_id)
SELECT d.company_id, coalesce(s, '') AS combined_features FROM d LEFT JOIN j ON d.company_id = j.company_id
"""
SQL["txt_ngrams"] = (
    f"WITH d AS ({TAILED}), t AS (SELECT company_id, {words(clean('description'))} AS w FROM d) "
    f"SELECT company_id, {bar(ngrams('w', 2))} AS bigrams, {bar(ngrams('w', 3))} AS trigrams FROM t"
)


def label_view(source: str, *extra: str) -> str:
    more = "".join(f", {e}" for e in extra)
    return (
        f"WITH l AS ({source}), t AS (SELECT *, {words('cleaned')} AS w FROM l) SELECT label_id{more}, "
        f"{bar('list_filter(w, lambda x: length(x) > 3)')} AS label_keywords, {bar(ngrams('w', 2))} AS label_bigrams FROM t"
    )


SQL["txt_label_keywords"] = label_view(PART_LABELS, "label")
_kinds = ["Real Estate", "construction and Retail", "Technology", "x", "Financial Consulting"]
_expandable = (
    f"p AS ({PART_LABELS}), l AS (SELECT label_id, {arr(_kinds)}[label_id % 5 + 1] || ' ' || label AS label, "
    "CASE WHEN label_id % 3 > 0 THEN cleaned END AS description FROM p)"
)
_syn_sql = ", ".join(
    f"CASE WHEN contains(lower(label), {q(k.lower())}) THEN {q(' '.join(v))} END" for k, v in L.LABEL_SYNONYMS.items()
)
_phr = (
    "flatten(list_transform(range(1, len(w)), lambda i: list_transform(range(i + 1, len(w) + 1), "
    "lambda j: array_to_string(w[i:j], ' '))))"
)
_expanded = (
    f"{_expandable}, x AS (SELECT *, string_split(label, ' ') AS w FROM l), "
    f"e AS (SELECT label_id, label, description, array_to_string(list_concat(list_filter([{_syn_sql}], lambda x: x IS NOT NULL), {_phr}), ' ') AS expanded_terms FROM x)"
)
SQL["txt_expand_label"] = f"WITH {_expanded} SELECT label_id, label, expanded_terms FROM e"
SQL["txt_expand_taxonomy"] = (
    f"WITH {_expanded}, f AS (SELECT label_id, label || ' ' || coalesce(description, '') || ' ' || expanded_terms AS expanded_description FROM e) "
    f"SELECT label_id, expanded_description, {clean('expanded_description')} AS cleaned_expanded FROM f"
)
for _name, _mode in (("txt_key_terms_opt", "optimized"), ("txt_key_terms_basic", "basic")):
    SQL[_name] = (
        f"WITH d AS ({DOCS}), t AS (SELECT company_id, {words('text')} AS w FROM d) "
        f"SELECT company_id, {bar(key_terms('w', _mode))} AS key_terms FROM t"
    )


# --- features --------------------------------------------------------------

def repeated(column: str, n: int) -> str:
    return f"CASE WHEN trim({column}) <> '' THEN array_to_string(list_transform(range({n}), lambda i: {column}), ' ') END"


_part_clean = (
    f"pc AS (SELECT company_id, {clean('description')} AS d, {clean('business_tags')} AS t, {clean('category')} AS c "
    f"FROM ({PARTS}))"
)
_part_combined = f"SELECT company_id, concat_ws(' ', {repeated('d', 10)}, {repeated('t', 15)}, {repeated('c', 20)}) AS text FROM pc"
SQL["feat_combined"] = f"WITH {_part_clean} SELECT company_id, text AS combined_features FROM ({_part_combined})"


def keyword_flags(text: str, only: list[str] = None) -> str:
    def hit(k):
        return rf"regexp_matches(lower(coalesce({text}, '')), '(^|[^\p{{L}}\p{{N}}_]){k}([^\p{{L}}\p{{N}}_]|$)')"

    flags = ", ".join(f"CAST({hit(k)} AS INTEGER) AS is_{k}" for k in (only or L.INDUSTRY_KEYWORDS))
    found = ", ".join(f"CASE WHEN {hit(k)} THEN {q(k)} END" for k in L.INDUSTRY_KEYWORDS)
    return f"{bar(f'list_filter([{found}], lambda x: x IS NOT NULL)')} AS detected_industries, {flags}"


SQL["feat_keywords"] = f"WITH d AS ({TAILED}) SELECT company_id, {keyword_flags('description')} FROM d"
_size = (
    "CASE WHEN employees < 10 THEN 'Micro' WHEN employees BETWEEN 10 AND 49 THEN 'Small' "
    "WHEN employees BETWEEN 50 AND 249 THEN 'Medium' WHEN employees BETWEEN 250 AND 999 THEN 'Large' "
    "WHEN employees >= 1000 THEN 'Enterprise' ELSE 'Unknown' END"
)
SQL["feat_size_category"] = f"""
SELECT user_id, {_size} AS size_category FROM (
  SELECT user_id, count(*)::DOUBLE AS employees FROM events GROUP BY user_id
  UNION ALL SELECT -p_partkey - 1, nullif(p_size, 7) * p_size / 2e0 - 1 FROM part)
"""
_place = """CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_name || ', ' || n_name
WHEN 2 THEN c_name || ',  ' || n_name || ',  ' || r_name
WHEN 3 THEN c_name || ',' || n_name || ',' || r_name || ',' || c_mktsegment END"""
SQL["feat_location"] = rf"""
WITH p AS (SELECT c_custkey, {_place} AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT c_custkey, string_split(place, ',') AS s FROM p)
SELECT c_custkey, s[1] AS city,
  CASE WHEN len(s) > 2 THEN ltrim(s[2]) END AS state,
  CASE WHEN len(s) > 2 THEN ltrim(array_to_string(s[3:], ',')) WHEN len(s) = 2 THEN ltrim(s[2]) END AS country
FROM x
"""
SQL["pipe_companies"] = (
    f"WITH d AS ({TAILED}), c AS (SELECT company_id, {clean('description')} AS cleaned_description, "
    f"{clean('sector')} AS cleaned_sector, {clean('category')} AS cleaned_category FROM d), "
    f"t AS (SELECT *, {words('cleaned_description')} AS w FROM c) "
    f"SELECT company_id, cleaned_description, cleaned_sector, cleaned_category, {bar(ngrams('w', 2))} AS description_bigrams, "
    f"{bar(ngrams('w', 3))} AS description_trigrams, {keyword_flags('cleaned_description', ['insurance', 'casualty', 'health'])} FROM t"
)
SQL["pipe_taxonomy"] = label_view(BENCH, "cleaned AS cleaned_label")
SQL["pipe_generic"] = f"""
WITH c AS (SELECT c_custkey AS company_id, c_name, lower(c_mktsegment) AS description,
  floor(abs(c_acctbal) / 10) AS employees, n_name, r_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT company_id, replace(c_name, '#', ' ') AS name, {_size} AS size_category,
  n_name AS city, r_name AS country, {keyword_flags('description', ['automotive'])} FROM c
"""
SQL["pipe_both"] = (
    f"WITH a AS (SELECT 'company' AS side, company_id AS id, {clean('description')} AS cleaned FROM ({PARTS}) "
    f"UNION ALL SELECT 'label', label_id, cleaned FROM ({PART_LABELS})), t AS (SELECT *, {words('cleaned')} AS w FROM a) "
    f"SELECT side, id, cleaned, {bar(ngrams('w', 2))} AS bigrams FROM t"
)


# --- lexicons --------------------------------------------------------------

def added_synonyms(terms: str, out: str, mode: str) -> str:
    """CTE ``out(id, cands)`` from ``terms(id, terms)``."""
    limits = (
        "AND t.pos <= 5 AND s.synset_rank <= 2 AND s.lemma_rank <= 3" if mode == "optimized" else ""
    )
    cut = "WHERE rn <= 10" if mode == "optimized" else ""
    return f"""
{out}_u AS (SELECT id, terms, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM {terms}),
{out}_c AS (
  SELECT id, cand, min(o) AS o FROM (
    SELECT t.id, t.terms, t.term, replace(s.lemma, '_', ' ') AS cand,
           (t.pos * 1000 + s.synset_rank) * 1000 + s.lemma_rank AS o
    FROM {out}_u t JOIN ({SYN}) s ON s.term = t.term WHERE NOT contains(t.term, ' ') {limits})
  WHERE cand <> term AND NOT list_contains(terms, cand) GROUP BY id, cand),
{out} AS (
  SELECT id, list(cand ORDER BY o) AS cands
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS rn FROM {out}_c) {cut} GROUP BY id)"""


def expanded(terms: str, name: str, mode: str) -> str:
    """CTE ``name(id, syn)``."""
    return (
        added_synonyms(terms, f"{name}_a", mode)
        + f", {name} AS (SELECT t.id, list_concat(t.terms, coalesce(a.cands, []::VARCHAR[])) AS syn FROM {terms} t LEFT JOIN {name}_a a ON t.id = a.id)"
    )


for _name, _mode in (("lex_synonyms_bounded", "optimized"), ("lex_synonyms_full", "basic")):
    SQL[_name] = (
        f"WITH d AS ({PART_TEXTS}), w AS (SELECT company_id, {words('text')} AS w FROM d), "
        f"kt AS (SELECT company_id AS id, {key_terms('w', _mode)} AS terms FROM w), {expanded('kt', 'x', _mode)} "
        f"SELECT id AS company_id, {bar('syn')} AS synonyms FROM x"
    )


def sector_list(text: str, lexicon: dict, mode: str) -> str:
    def hit(keywords):
        tests = []
        for k in keywords:
            if " " in k or mode == "basic":
                tests.append(f"contains(lower({text}), {q(k)})")
            else:
                tests.append(f"list_contains({words(f'lower({text})')}, {q(k)})")
        return " OR ".join(tests)

    items = ", ".join(f"CASE WHEN {hit(ks)} THEN {q(s)} END" for s, ks in lexicon.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


SQL["lex_sectors_word"] = (
    f"WITH d AS ({TAILED}) SELECT company_id, {bar(sector_list('description', L.SECTOR_KEYWORDS, 'optimized'))} AS insurance_sectors FROM d"
)
SQL["lex_sectors_substring"] = (
    f"WITH d AS ({TAILED}) SELECT company_id, {bar(sector_list('description', L.SECTOR_KEYWORDS, 'basic'))} AS insurance_sectors FROM d"
)
SQL["feat_label_features"] = (
    f"WITH l AS ({PART_LABELS}), w AS (SELECT *, {words('cleaned')} AS w FROM l), "
    f"k AS (SELECT *, {key_terms('w', 'optimized')} AS kt FROM w), kt AS (SELECT label_id AS id, kt[1:10] AS terms FROM k), "
    f"{expanded('kt', 'x', 'optimized')} SELECT label_id, {bar('kt')} AS key_terms, {bar('syn')} AS synonyms, "
    f"{bar(sector_list('cleaned', I.PART_SECTORS, 'optimized'))} AS insurance_sectors FROM k JOIN x ON id = label_id"
)
SQL["model_config_roundtrip"] = f"""
WITH d AS ({PART_TEXTS}), t AS (SELECT company_id, {vtokens('text')} AS t FROM d),
g AS (SELECT DISTINCT company_id, unnest(list_concat(t, {ngrams('t', 2)}, {ngrams('t', 3)})) AS term FROM t),
f AS (SELECT term FROM g GROUP BY term HAVING count(*) BETWEEN 2 AND 0.8 * (SELECT count(*) FROM d))
SELECT company_id, {bar(sector_list('text', I.PART_SECTORS, 'basic'))} AS sectors, 4 AS top_k, 0.07e0 AS threshold, 'basic' AS mode,
  FALSE AS ensure_one_tag, TRUE AS require_positive_best, 'cleaned_label' AS bonus_on, 2 AS min_df, 0.8e0 AS max_df,
  0.5e0 AS tfidf_weight, 0.3e0 AS wordnet_weight, 0.1e0 AS keyword_weight,
  (SELECT count(*) FROM d) AS n_docs, (SELECT count(*) FROM f) AS terms FROM d
"""


# --- TF-IDF ----------------------------------------------------------------

def tfidf_ctes(companies: str, labels: str) -> str:
    return f"""
companies AS ({companies}), labels AS ({labels}),
docs AS (SELECT 'company' AS side, CAST(company_id AS VARCHAR) AS id, text FROM companies
         UNION ALL SELECT 'label', CAST(label_id AS VARCHAR), cleaned FROM labels),
toks AS (SELECT side, id, {vtokens('text')} AS t FROM docs),
tf AS (SELECT side, id, term, count(*) AS tf FROM (
  SELECT side, id, unnest(list_concat(t, {ngrams('t', 2)}, {ngrams('t', 3)})) AS term FROM toks) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM docs),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln((1e0 + n) / (1e0 + df)) + 1e0 AS idf FROM df, n WHERE df <= 0.9e0 * n),
w AS (SELECT side, id, term, (1e0 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
nrm AS (SELECT side, id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY ALL),
u AS (SELECT side, id, term, w / nrm AS u FROM w JOIN nrm USING (side, id)),
cos AS (SELECT c.id AS cid, CAST(l.id AS BIGINT) AS lid, sum(c.u * l.u) AS cos
        FROM u c JOIN u l ON c.term = l.term AND c.side = 'company' AND l.side = 'label' GROUP BY ALL)"""


_turn = f"WITH {tfidf_ctes(TURNS, BENCH)} "
SQL["tfidf_fit"] = _turn.replace(TURNS, DOCS) + "SELECT term, df, round(idf, 6) AS idf, (SELECT count(*) FROM docs) AS n_docs FROM idf"
SQL["tfidf_terms"] = _turn + "SELECT side || ':' || id AS doc, term, tf FROM tf"
SQL["tfidf_df_prune"] = _turn + "SELECT term, df FROM idf"
SQL["tfidf_idf"] = _turn + "SELECT term, round(idf, 6) AS idf FROM idf"
SQL["tfidf_weights"] = _turn + "SELECT side || ':' || id AS doc, term, round(w, 6) AS weight FROM w"
SQL["tfidf_norm"] = _turn + "SELECT side || ':' || id AS doc, term, round(u, 6) AS weight FROM u"
SQL["model_tfidf_roundtrip"] = _turn + "SELECT term, df, round(idf, 6) AS idf FROM idf"
SQL["model_vocabulary_merge"] = _turn + "SELECT term, df, round(idf, 6) AS idf, (SELECT count(*) FROM docs) AS n_docs FROM idf"
SQL["tfidf_vocab_size"] = (
    f"WITH {tfidf_ctes(DOCS, 'SELECT 0 AS label_id, CAST(NULL AS VARCHAR) AS cleaned WHERE FALSE')} "
    "SELECT count(*) AS vocabulary_size FROM idf"
)


def under_vocabulary(sources: dict[str, str]) -> str:
    """CTE ``v(side, id, term, u)``: texts under the vocabulary ``idf``."""
    union = " UNION ALL ".join(
        f"SELECT {q(s)} AS side, CAST(id AS VARCHAR) AS id, text FROM ({sql})" for s, sql in sources.items()
    )
    return f"""
nd AS ({union}), nt AS (SELECT side, id, {vtokens('text')} AS t FROM nd),
ntf AS (SELECT side, id, term, count(*) AS tf FROM (
  SELECT side, id, unnest(list_concat(t, {ngrams('t', 2)}, {ngrams('t', 3)})) AS term FROM nt) GROUP BY ALL),
nw AS (SELECT side, id, term, (1e0 + ln(tf)) * idf AS w FROM ntf JOIN idf USING (term)),
v AS (SELECT side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS u FROM nw)"""


_as_id = "SELECT company_id AS id, text FROM ({})"
SQL["tfidf_transform"] = (
    _turn[:-1] + ", " + under_vocabulary({"part": _as_id.format(PART_TEXTS), "document": _as_id.format(DOCS)})
    + " SELECT side, CAST(id AS BIGINT) AS company_id, term, round(u, 6) AS weight FROM v"
)
_doc = f"WITH {tfidf_ctes(DOCS, BENCH)} "
SQL["sim_cosine"] = _doc + "SELECT CAST(cid AS BIGINT) AS company_id, lid AS label_id, round(cos, 6) AS score FROM cos"


def topk(pairs: str, k: int, threshold: float) -> str:
    return f"""top AS (SELECT * FROM (
  SELECT cid, lid, cos, row_number() OVER (PARTITION BY cid ORDER BY round(cos, 9) DESC, lid DESC) AS rank FROM {pairs})
  WHERE rank <= {k} AND round(cos, 9) >= {threshold})"""


SQL["rank_topk_tfidf"] = (
    _doc[:-1] + ", " + topk("cos", 5, 0.02)
    + " SELECT CAST(cid AS BIGINT) AS company_id, lid AS label_id, round(cos, 6) AS score, rank FROM top"
)


def tfidf_result(pairs: str, docs: str = DOCS) -> str:
    return f"""{topk(pairs, 3, 0.05)},
lst AS (SELECT cid, list(label ORDER BY rank) AS ls, list(cos ORDER BY rank) AS ss FROM top JOIN labels ON lid = label_id GROUP BY cid),
res AS (SELECT c.company_id, coalesce(ls, []::VARCHAR[]) AS labels, coalesce(ss, []::DOUBLE[]) AS scores
        FROM ({docs}) c LEFT JOIN lst ON CAST(c.company_id AS VARCHAR) = cid)
SELECT {shown()} FROM res"""


SQL["pipe_tfidf_classify"] = _doc[:-1] + ", " + tfidf_result("cos")
_EVENT = "event_type || ' ' || CASE WHEN value < 5 THEN 'tiny' WHEN value < 20 THEN 'middling' ELSE 'huge' END"
_EVENTS = f"SELECT event_id AS company_id, {_EVENT} || ' ' || ({I.EVENT_USERS!r})[1 + user_id % 5] AS text FROM events"
_EVENT_LABELS = f"SELECT row_number() OVER (ORDER BY label) - 1 AS label_id, label, label AS cleaned FROM (SELECT DISTINCT {_EVENT} AS label FROM events)"
SQL["pipe_score_stream"] = f"WITH {tfidf_ctes(_EVENTS, _EVENT_LABELS)}, " + tfidf_result("cos", _EVENTS)
SQL["pipe_score_saved"] = (
    _turn[:-1] + ", "
    + under_vocabulary({"company": _as_id.format(DOCS), "label": f"SELECT label_id AS id, cleaned AS text FROM ({BENCH})"})
    + """, cos2 AS (SELECT c.id AS cid, CAST(l.id AS BIGINT) AS lid, sum(c.u * l.u) AS cos
  FROM v c JOIN v l ON c.term = l.term AND c.side = 'company' AND l.side = 'label' GROUP BY ALL), """
    + tfidf_result("cos2")
)


# --- ensemble --------------------------------------------------------------

def boost(j: str) -> str:
    return f"CASE WHEN {j} > 0.5e0 THEN 0.5e0 + {j} * 0.5e0 ELSE {j} END"


def ensemble_ctes(companies: str, labels: str, mode: str, sectors: dict, synonyms: bool = True) -> str:
    """CTE ``comp(cid, lid, label, tfidf, keyword, wordnet, bonus)`` of all
    pairs."""
    cut = "[1:10]" if mode == "optimized" else ""

    def syn(terms, name):
        if synonyms:
            return expanded(terms, name, mode)
        return f"{name} AS (SELECT id, terms AS syn FROM {terms})"

    return f"""{tfidf_ctes(companies, labels)},
cw AS (SELECT CAST(company_id AS VARCHAR) AS id, text, {words('lower(text)')} AS w FROM companies),
lw AS (SELECT label_id AS id, label, cleaned, {words('lower(cleaned)')} AS w, list_distinct({words('lower(label)')}) AS rw FROM labels),
ckt AS (SELECT id, ({key_terms('w', mode)}){cut} AS terms FROM cw),
lkt AS (SELECT id, ({key_terms('w', mode)}){cut} AS terms FROM lw),
{syn('ckt', 'csyn')}, {syn('lkt', 'lsyn')},
cf AS (SELECT cw.id, list_distinct(w) AS w, list_distinct(syn) AS syn, {sector_list('text', sectors, mode)} AS sec FROM cw JOIN csyn ON cw.id = csyn.id),
lf AS (SELECT lw.id, label, rw, list_distinct(syn) AS syn, {sector_list('cleaned', sectors, mode)} AS sec FROM lw JOIN lsyn ON lw.id = lsyn.id),
ov AS (SELECT c.id AS cid, l.id AS lid, label,
  len(list_intersect(c.sec, l.sec)) AS si, len(c.sec) AS s1, len(l.sec) AS s2,
  len(list_intersect(c.syn, l.syn)) AS yi, len(c.syn) AS y1, len(l.syn) AS y2,
  len(list_intersect(c.w, l.rw)) AS wi, len(l.rw) AS w2 FROM cf c, lf l),
jac AS (SELECT cid, lid, label,
  CASE WHEN s1 = 0 OR s2 = 0 THEN 0e0 ELSE si::DOUBLE / (s1 + s2 - si) END AS js,
  CASE WHEN y1 = 0 OR y2 = 0 THEN 0e0 ELSE yi::DOUBLE / (y1 + y2 - yi) END AS jy,
  CASE WHEN w2 = 0 THEN 0e0 ELSE 0.3e0 * wi / w2 END AS bonus FROM ov),
comp AS (SELECT jac.cid, jac.lid, label, coalesce(cos, 0e0) AS tfidf, {boost('js')} AS keyword, {boost('jy')} AS wordnet, bonus
  FROM jac LEFT JOIN cos ON jac.cid = cos.cid AND jac.lid = cos.lid)"""


def scored_ctes(params: str) -> str:
    """``scored``: rescaled and ranked pairs per trial.  ``params`` has columns
    trial_id, top_k, threshold, wt, ww, wk."""
    return f"""
params AS ({params}),
raw AS (SELECT trial_id, top_k, threshold, cid, lid, label,
  wt * tfidf + wk * keyword + ww * wordnet + bonus AS raw FROM comp, params),
scored AS (SELECT *,
  CASE WHEN max(raw * raw) OVER (PARTITION BY trial_id, cid) > 0 THEN raw * raw / max(raw * raw) OVER (PARTITION BY trial_id, cid) ELSE 0e0 END AS score,
  row_number() OVER (PARTITION BY trial_id, cid ORDER BY round(raw, 9) DESC, lid DESC) AS rank FROM raw),
kept AS (SELECT * FROM scored WHERE rank <= top_k AND (round(score, 9) >= threshold OR rank = 1)),
res AS (SELECT trial_id, cid, list(label ORDER BY rank) AS labels, list(score ORDER BY rank) AS scores,
  list(raw ORDER BY rank) AS raws FROM kept GROUP BY ALL)"""


DEFAULT = "SELECT 0 AS trial_id, 3 AS top_k, 0.05e0 AS threshold, 0.6e0 AS wt, 0.25e0 AS ww, 0.15e0 AS wk"
_short = f"WITH {ensemble_ctes(PART_TEXTS, PART_LABELS, 'optimized', I.PART_SECTORS)} "
for _name, _col in (("sim_sector_jaccard", "keyword"), ("sim_synonym_jaccard", "wordnet"), ("sim_exact_bonus", "bonus")):
    SQL[_name] = (
        _short + f"SELECT CAST(cid AS BIGINT) AS company_id, lid AS label_id, round({_col}, 6) AS {_col} FROM comp WHERE {_col} > 0"
    )
_short_scored = _short[:-1] + ", " + scored_ctes(DEFAULT)
SQL["score_ensemble"] = _short_scored + " SELECT CAST(cid AS BIGINT) AS company_id, lid AS label_id, round(raw, 6) AS raw_score FROM raw WHERE raw > 0"
SQL["score_rescale"] = _short_scored + " SELECT CAST(cid AS BIGINT) AS company_id, lid AS label_id, round(score, 6) AS score FROM scored WHERE raw > 0"
SQL["rank_topk_ensemble"] = (
    _short_scored + " SELECT CAST(cid AS BIGINT) AS company_id, lid AS label_id, round(score, 6) AS score, rank FROM scored "
    "WHERE raw > 0 AND rank <= 5 AND round(score, 9) >= 0.08"
)


def shown_ensemble(cast: str = "CAST(cid AS BIGINT)") -> str:
    return f" SELECT {shown(f'{cast} AS company_id')} FROM res"


SQL["rank_ensure_one"] = (
    f"WITH {ensemble_ctes(TURNS, PART_LABELS, 'optimized', I.PART_SECTORS, synonyms=False)}, {scored_ctes(DEFAULT)}"
    + shown_ensemble("cid")
)
_combined = f"SELECT * FROM (WITH {_part_clean} {_part_combined})"
SQL["pipe_ensemble_opt"] = (
    f"WITH {ensemble_ctes(_combined, PART_LABELS, 'optimized', I.PART_SECTORS)}, {scored_ctes(DEFAULT)}" + shown_ensemble()
)
SQL["pipe_run"] = SQL["pipe_ensemble_opt"]
SQL["pipe_ensemble_opt"] = SQL["pipe_run"].replace(
    " FROM res", ", array_to_string(list_transform(raws, lambda x: CAST(round(x * 1000000, 0) AS BIGINT)), '|') AS insurance_label_raw_scores FROM res"
)
SQL["pipe_score_loaded"] = SQL["pipe_run"]
SQL["pipe_ensemble_basic"] = (
    f"WITH {ensemble_ctes(_combined, PART_LABELS, 'basic', I.PART_SECTORS)}, {scored_ctes(DEFAULT)}" + shown_ensemble()
)

_SECTORED = (
    "SELECT p_partkey AS company_id, p_type AS sector, nullif(p_brand, 'Brand#7') AS category, "
    "CASE WHEN p_size > 9 THEN p_name END AS niche FROM part"
)
_sector_hits = "list_sum([0.0e0, " + ", ".join(
    f"CASE WHEN ({' OR '.join(f'contains(info, {q(k)})' for k in ks)}) AND ({' OR '.join(f'contains(low, {q(k)})' for k in ks)}) THEN 0.3e0 ELSE 0e0 END"
    for ks in I.PART_SECTORS.values()
) + "])"
_fallback = f"""
si AS (SELECT company_id, lower(coalesce(sector, '') || ' ' || coalesce(category, '') || ' ' || coalesce(niche, '')) AS info FROM ({_SECTORED})),
sp AS (SELECT company_id, label_id, label, round(
  0.2e0 * len(list_filter({words('info')}, lambda x: length(x) > 3 AND contains(low, x))) + {_sector_hits}, 9) AS score
  FROM si, (SELECT label_id, label, lower(label) AS low FROM ({PART_LABELS}))),
sf AS (SELECT company_id, label, score FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, label_id) AS rn FROM sp) WHERE rn = 1 AND score >= 0.2)"""
SQL["sim_sector_fallback"] = f"WITH {_fallback} SELECT company_id, label, round(score, 6) AS score FROM sf"
_chain_companies = f"SELECT company_id, CASE WHEN company_id % 3 = 0 THEN '' ELSE lower(sector) END AS text FROM ({_SECTORED})"
_chain_labels = f"SELECT label_id, label, CASE WHEN label_id % 2 = 0 THEN cleaned ELSE '' END AS cleaned FROM ({PART_LABELS})"
SQL["rank_fallback_chain"] = (
    f"WITH {ensemble_ctes(_chain_companies, _chain_labels, 'optimized', I.PART_SECTORS, synonyms=False)}, {scored_ctes(DEFAULT)}, {_fallback}, "
    "pos AS (SELECT cid, list(label ORDER BY rank) AS ls, list(score ORDER BY rank) AS ss FROM kept WHERE raw > 0 GROUP BY cid), "
    "chain AS (SELECT c.company_id, coalesce(ls, [coalesce(sf.label, 'General Insurance')]) AS labels, "
    "coalesce(ss, [coalesce(sf.score, 0.1e0)]) AS scores FROM companies c LEFT JOIN pos ON cid = CAST(c.company_id AS VARCHAR) "
    f"LEFT JOIN sf ON sf.company_id = c.company_id) SELECT {shown()} FROM chain"
)
SQL["score_weights"] = """
WITH x AS (SELECT l_orderkey, l_linenumber, l_discount AS t, l_tax AS w,
  CASE WHEN l_linenumber = 1 THEN 0e0 ELSE l_quantity / 100 END AS k FROM lineitem),
y AS (SELECT *, t + w + k AS s FROM x)
SELECT l_orderkey, l_linenumber, round(CASE WHEN s > 0 THEN t / s ELSE t END, 6) AS tfidf_weight,
  round(CASE WHEN s > 0 THEN w / s ELSE w END, 6) AS wordnet_weight,
  round(CASE WHEN s > 0 THEN k / s ELSE k END, 6) AS keyword_weight FROM y
"""
SQL["agg_labels_list"] = f"""
WITH x AS (SELECT l_orderkey, list(l_returnflag || '-' || l_linestatus ORDER BY l_linenumber, l_returnflag || '-' || l_linestatus, l_discount) AS labels,
  list(l_discount ORDER BY l_linenumber, l_returnflag || '-' || l_linestatus, l_discount) AS scores FROM lineitem GROUP BY l_orderkey)
SELECT {shown('l_orderkey')} FROM x
"""

# --- evaluation ------------------------------------------------------------

_c = f"WITH {CLASSIFIED} "
_top = "SELECT label, count(*) AS assignments FROM exploded GROUP BY label ORDER BY assignments {}, label LIMIT 10"
_hist = (
    "SELECT b AS labels, (SELECT count(*) FROM classified WHERE CASE WHEN len(labels) >= 4 THEN '4+' ELSE CAST(len(labels) AS VARCHAR) END = b) AS companies "
    "FROM (SELECT unnest(['0', '1', '2', '3', '4+']) AS b)"
)
_edges = [("0.0-0.1", 0.0, 0.1), ("0.1-0.2", 0.1, 0.2), ("0.2-0.3", 0.2, 0.3), ("0.3-0.4", 0.3, 0.4),
          ("0.4-0.5", 0.4, 0.5), ("0.5-0.6", 0.5, 0.6), ("0.6-0.7", 0.6, 0.7), ("0.7-0.8", 0.7, 0.8),
          ("0.8-0.9", 0.8, 0.9), ("0.9-1.0", 0.9, 1.0)]
_bins = (
    "SELECT b AS score_range, (SELECT count(*) FROM exploded WHERE (score >= lo AND score < hi) OR (hi = 1 AND score = 1)) AS assignments "
    f"FROM {values(_edges)} v(b, lo, hi)"
)
_sum = (
    "SELECT count(*) AS total_companies, count(*) FILTER (len(labels) > 0) AS companies_with_labels, "
    "count(*) FILTER (len(labels) = 0) AS companies_without_labels, "
    "round(100e0 * count(*) FILTER (len(labels) > 0) / count(*), 6) AS coverage_percentage, "
    "CAST(sum(len(labels)) AS BIGINT) AS total_labels_assigned, round(sum(len(labels))::DOUBLE / count(*), 6) AS avg_labels_per_company, "
    "(SELECT count(DISTINCT label) FROM exploded) AS unique_labels_used FROM classified"
)
_stats = (
    "SELECT round(avg(score), 6) AS avg_score, round(median(score), 6) AS median_score, "
    "round(min(score), 6) AS min_score, round(max(score), 6) AS max_score FROM exploded"
)
SQL["eval_summary"] = _c + _sum
SQL["eval_label_histogram"] = _c + _hist
SQL["eval_top_labels"] = _c + _top.format("DESC")
SQL["eval_bottom_labels"] = _c + _top.format("ASC")
SQL["eval_companies_per_label"] = _c + "SELECT label, count(*) AS assignments, count(DISTINCT company_id) AS companies FROM exploded GROUP BY label"
SQL["eval_assignment_stats"] = (
    _c + f"SELECT total_companies, total_labels_assigned AS total_label_assignments, unique_labels_used AS unique_labels, avg_labels_per_company FROM ({_sum})"
)
SQL["eval_score_stats"] = _c + _stats
SQL["eval_score_histogram"] = _c + _bins
SQL["eval_coverage"] = _c + f"SELECT total_companies, companies_with_labels, companies_without_labels, coverage_percentage FROM ({_sum})"


def long_form(section: str, sql: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {q(section)} AS section, {q(c)} AS metric, CAST({c} AS DOUBLE) AS value FROM ({sql})" for c in columns
    )


def section(name: str, sql: str, metric: str, value: str) -> str:
    return f"SELECT {q(name)} AS section, {metric} AS metric, CAST({value} AS DOUBLE) AS value FROM ({sql})"


_per_label = "SELECT label, count(DISTINCT company_id) AS companies FROM exploded GROUP BY label"
SQL["eval_report"] = _c + " UNION ALL ".join([
    long_form("general", _sum, ["total_companies", "companies_with_labels", "companies_without_labels",
                                "coverage_percentage", "total_labels_assigned", "avg_labels_per_company", "unique_labels_used"]),
    section("labels_per_company", _hist, "labels", "companies"),
    section("top_labels", _top.format("DESC"), "label", "assignments"),
    section("bottom_labels", _top.format("ASC"), "label", "assignments"),
    section("companies_per_label", _per_label, "label", "companies"),
    long_form("scores", _stats, ["avg_score", "median_score", "min_score", "max_score"]),
    section("score_ranges", _bins, "score_range", "assignments"),
])
SQL["sink_report"] = SQL["eval_report"]
SQL["eval_report_merged"] = SQL["eval_report"]
SQL["eval_chart_data"] = _c + " UNION ALL ".join(
    f"SELECT {q(n)} AS chart, {x} AS x, {y} AS y FROM ({s})"
    for n, s, x, y in (("top_labels", _top.format("DESC"), "label", "assignments"),
                       ("labels_per_company", _hist, "labels", "companies"),
                       ("score_ranges", _bins, "score_range", "assignments"))
)
SQL["rel_filter_threshold"] = _c + "SELECT company_id, label, round(score, 6) AS score FROM exploded WHERE round(score, 9) >= 0.3"
SQL["sink_classified"] = _c + f"SELECT {shown()} FROM classified"
SQL["src_results"] = SQL["sink_classified"]
SQL["arr_parse_labels"] = _c + (
    f"SELECT company_id, len(l) AS n, {bar('l')} AS labels FROM (SELECT company_id, CASE WHEN company_id % 3 = 0 THEN labels "
    "ELSE list_transform(labels, lambda x: replace(x, 'H', '''')) END AS l FROM classified)"
)
SQL["sink_export"] = _c + (
    "SELECT c_name AS description, CASE WHEN len(labels) > 0 THEN array_to_string(labels, ', ') ELSE 'Unclassified' END AS insurance_label, "
    "c_mktsegment AS sector, array_to_string(list_transform(scores, lambda x: printf('%.4f', x)), ', ') AS label_scores FROM classified"
)

# --- parameter search ------------------------------------------------------

_SAMPLE = "SELECT {0} AS company_id FROM {1} ORDER BY md5('42:' || {0}), {0} LIMIT 200"
SQL["tune_sample"] = _SAMPLE.format("doc_id", "documents")
SQL["tune_objective"] = _c.rstrip() + """,
m AS (SELECT c_nationkey AS trial_id, labels, CASE WHEN len(scores) > 0 THEN list_sum(scores) / len(scores) END AS mean FROM classified),
p AS (SELECT trial_id, avg(CASE WHEN len(labels) > 0 THEN 1e0 ELSE 0e0 END) AS coverage, coalesce(avg(mean), 0e0) AS confidence FROM m GROUP BY trial_id),
d AS (SELECT trial_id, count(DISTINCT label) / 8e0 AS diversity FROM (SELECT trial_id, unnest(labels) AS label FROM m) GROUP BY trial_id)
SELECT p.trial_id, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence, round(coalesce(diversity, 0e0), 6) AS diversity,
  round(0.4e0 * coverage + 0.4e0 * confidence + 0.2e0 * coalesce(diversity, 0e0), 6) AS score
FROM p LEFT JOIN d ON p.trial_id = d.trial_id"""
_sampled = f"SELECT * FROM ({PART_TEXTS}) WHERE company_id IN (SELECT company_id FROM ({_SAMPLE.format('p_partkey', 'part')}))"
_trials = f"SELECT * FROM {values(I.TRIALS)} v(trial_id, top_k, threshold, wt, ww, wk)"


def search_sql(companies: str) -> str:
    return f"""WITH {ensemble_ctes(companies, PART_LABELS, 'optimized', I.PART_SECTORS)}, {scored_ctes(_trials)},
obj AS (SELECT trial_id, avg(CASE WHEN len(labels) > 0 THEN 1e0 ELSE 0e0 END) AS coverage, avg(list_sum(scores) / len(scores)) AS confidence FROM res GROUP BY trial_id),
dv AS (SELECT trial_id, count(DISTINCT label)::DOUBLE / (SELECT count(*) FROM labels) AS diversity FROM kept GROUP BY trial_id),
fin AS (SELECT *, 0.4e0 * coverage + 0.4e0 * confidence + 0.2e0 * diversity AS score FROM obj JOIN dv USING (trial_id) JOIN params USING (trial_id)),
hist AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, trial_id) AS position FROM fin)"""


_search = search_sql(_sampled)
SQL["tune_search"] = _search + (
    " SELECT trial_id, position, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence, "
    "round(diversity, 6) AS diversity, round(score, 6) AS score FROM hist"
)
SQL["tune_search_full"] = SQL["tune_search"].replace(_search, search_sql(PART_TEXTS))
SQL["tune_history"] = _search + (
    " SELECT trial_id, top_k, position, round(threshold, 6) AS threshold, round(wt, 6) AS tfidf_weight, round(score, 6) AS score FROM hist"
)
_best = f"SELECT trial_id, top_k, threshold, wt, ww, wk FROM ({_search} SELECT * FROM hist WHERE position = 1)"
SQL["tune_apply_best"] = (
    f"WITH {ensemble_ctes(PART_TEXTS, PART_LABELS, 'optimized', I.PART_SECTORS)}, {scored_ctes(_best)}" + shown_ensemble()
)

SQL["tune_density"] = _search + """,
space AS (SELECT * FROM (VALUES ('top_k', 1e0, 10e0), ('threshold', 0.01e0, 0.3e0), ('tfidf_weight', 0.04e0, 0.9e0),
  ('wordnet_weight', 0.04e0, 0.9e0), ('keyword_weight', 0.04e0, 0.9e0)) v(parameter, low, high)),
seen AS (SELECT position <= ceil(0.4e0 * (SELECT count(*) FROM hist)) AS good, unnest(['top_k', 'threshold', 'tfidf_weight', 'wordnet_weight', 'keyword_weight']) AS parameter,
  unnest([top_k::DOUBLE, threshold::DOUBLE, wt::DOUBLE, ww::DOUBLE, wk::DOUBLE]) AS value FROM hist),
width AS (SELECT parameter, good, count(*) AS n, greatest(stddev_pop(value) * count(*) ** (-0.2e0), any_value(high - low) / 50) AS h
  FROM seen JOIN space USING (parameter) GROUP BY ALL),
grid AS (SELECT parameter, point, low, high, low + point * ((high - low) / 10) AS x FROM space, (SELECT unnest(range(11)) AS point) r),
dens AS (SELECT grid.parameter, point, x, good, (any_value(1 / (high - low)) + sum(exp(-(((x - value) / h) ** 2) / 2) / (h * sqrt(2 * pi())))) / (count(*) + 1) AS d
  FROM grid JOIN seen USING (parameter) JOIN width USING (parameter, good) GROUP BY ALL)
SELECT parameter, point, round(x, 6) AS x, round(max(d) FILTER (good), 6) AS good, round(max(d) FILTER (NOT good), 6) AS bad FROM dens GROUP BY parameter, point, x"""
SQL["tune_objective_f1"] = _c.rstrip() + """,
given AS (SELECT DISTINCT o_custkey AS company_id, o_orderpriority AS label FROM orders WHERE month(o_orderdate) % 2 = 0 AND o_orderpriority IS NOT NULL),
trial AS (SELECT company_id, c_nationkey AS trial_id, labels FROM classified),
guess AS (SELECT DISTINCT trial_id, company_id, unnest(labels) AS label FROM trial WHERE company_id IN (SELECT company_id FROM given)),
truth AS (SELECT trial_id, company_id, label FROM trial JOIN given USING (company_id)),
cell AS (SELECT trial_id, label, (g.label IS NOT NULL)::INT AS p, (t.label IS NOT NULL)::INT AS g
  FROM guess g FULL JOIN truth t USING (trial_id, company_id, label)),
per AS (SELECT trial_id, label, sum(p) AS p, sum(g) AS g, sum(p * g) AS b FROM cell GROUP BY ALL)
SELECT n.trial_id, round(coalesce(sum(b) / nullif(sum(p), 0), 0e0), 6) AS micro_precision, round(coalesce(sum(b) / nullif(sum(g), 0), 0e0), 6) AS micro_recall,
  round(coalesce(2 * sum(b) / nullif(sum(p + g), 0), 0e0), 6) AS micro_f1, round(coalesce(avg(coalesce(b / nullif(p, 0), 0e0)), 0e0), 6) AS macro_precision,
  round(coalesce(avg(coalesce(b / nullif(g, 0), 0e0)), 0e0), 6) AS macro_recall, round(coalesce(avg(coalesce(2 * b / nullif(p + g, 0), 0e0)), 0e0), 6) AS macro_f1
FROM (SELECT DISTINCT trial_id FROM trial) n LEFT JOIN per USING (trial_id) GROUP BY n.trial_id"""

# --- sources and sinks -----------------------------------------------------

_messy = """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'say "hi", ' || s_name WHEN 1 THEN s_name || chr(10) || 'second line'
  WHEN 3 THEN s_name END AS description,
  CASE WHEN s_suppkey % 4 < 3 THEN 'sector ' || (s_suppkey % 4) END AS sector, s_acctbal FROM supplier
"""
SQL["src_scan_csv"] = _messy
SQL["src_scan_csv_split"] = _messy
SQL["src_scan_json"] = _messy.replace("WHEN 3 THEN s_name END", "WHEN 2 THEN 'N/A' ELSE s_name END").replace(
    "THEN 'sector ' || (s_suppkey % 4) END", "THEN 'sector ' || (s_suppkey % 4) ELSE 'null' END"
)
SQL["src_scan_synsets"] = """
WITH p AS (SELECT p_partkey, p_partkey % 3 = 0 AS verb, [replace(p_name, ' ', '_'), p_type, p_brand] AS words FROM part),
w AS (SELECT p_partkey, verb, unnest(words) AS lemma, generate_subscripts(words, 1) AS lemma_rank FROM p),
t AS (SELECT DISTINCT replace(lower(lemma), '_', ' ') AS term, verb, p_partkey FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY verb, p_partkey) AS synset_rank FROM t)
SELECT term, synset_rank, lemma_rank, lemma FROM r JOIN w USING (p_partkey, verb)
"""
SQL["src_two_tables"] = f"""
SELECT description || '/' || category AS text, count(*) AS n FROM ({PARTS}) GROUP BY ALL
UNION ALL SELECT label, label_id FROM ({PART_LABELS})
"""
SQL["src_reload"] = (
    f"WITH {_part_clean}, t AS (SELECT company_id, d AS cleaned, {words('d')} AS w FROM pc), x AS ({_part_combined}) "
    f"SELECT x.company_id, text AS combined_features, {bar(ngrams('w', 2))} AS description_bigrams FROM x JOIN t ON x.company_id = t.company_id"
)
SQL["sink_processed"] = SQL["pipe_taxonomy"]
