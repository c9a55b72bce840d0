"""SQL building blocks for the checks: the same tables derived independently in DuckDB SQL."""

from __future__ import annotations

from talkloom.functions.lemmas import IRREGULAR
from talkloom.functions.stopwords import stopwords


def words_sql(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


NON_ASCII = r"regexp_matches({}, '[^\x00-\x7F]')"

# Messages of every conversation in the flat fixture, with the columns of the raw logs.
MESSAGES = rf"""
base AS (
  SELECT conv_id, role, text,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) - 1 AS pos
  FROM conversations),
cnt AS (
  SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS turn,
         max(CASE WHEN {NON_ASCII.format('text')} THEN 1 ELSE 0 END) AS na
  FROM base GROUP BY conv_id),
every AS (
  SELECT md5(CAST(b.conv_id % 60 AS VARCHAR)) AS conversation_hash,
         md5(CAST(CAST(floor(b.conv_id / 3.0) AS BIGINT) AS VARCHAR)) AS hashed_ip,
         'model-' || (b.conv_id % 2) AS model, 'State ' || (b.conv_id % 5) AS state,
         CASE b.conv_id % 4 WHEN 0 THEN 'France' WHEN 1 THEN 'Canada' ELSE 'India' END AS country,
         c.turn,
         CASE WHEN c.na = 1 AND b.conv_id % 5 <> 0 THEN 'French' ELSE 'English' END AS language,
         b.pos, CAST(floor(b.pos / 2.0) AS BIGINT) AS turn_identifier, b.role, b.text AS content,
         CASE WHEN (c.turn = 1 AND b.conv_id % 2 = 0 AND b.pos = 0)
                OR (b.conv_id * 7 + b.pos * 3) % 23 = 0 THEN 'Nolang'
              WHEN b.conv_id % 11 = 0 THEN 'Latin'
              WHEN {NON_ASCII.format('b.text')} THEN 'French' ELSE 'English' END AS language_message
  FROM base b JOIN cnt c ON b.conv_id = c.conv_id),
messages AS (
  SELECT conversation_hash || '_' || hashed_ip AS conversation_id, * EXCLUDE (language), language AS lang_conv
  FROM every WHERE language = 'English'),
empty_turns AS (
  SELECT DISTINCT conversation_id, turn_identifier FROM messages
  WHERE turn = 1 AND language_message = 'Nolang'),
spoken AS (
  SELECT * FROM messages ANTI JOIN empty_turns USING (conversation_id, turn_identifier)),
cleaned AS (SELECT * FROM spoken WHERE language_message IN ('English', 'Latin')),
assembled AS (
  SELECT conversation_id,
         arg_min(content, pos) FILTER (WHERE role = 'user') AS first_user_content,
         coalesce(string_agg(content, E'\n\n' ORDER BY pos) FILTER (WHERE role = 'user'), '') AS all_user_content,
         coalesce(string_agg(content, E'\n\n' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')
           AS all_assistant_content,
         coalesce(string_agg(content, E'\n\n' ORDER BY pos), '') AS all_content,
         arg_min(conversation_hash, pos) AS conversation_hash, arg_min(turn, pos) AS turn,
         arg_min(lang_conv, pos) AS lang_conv, arg_min(state, pos) AS state, arg_min(country, pos) AS country,
         arg_min(hashed_ip, pos) AS hashed_ip
  FROM cleaned GROUP BY conversation_id)
"""


def without_links(text: str) -> str:
    return (
        rf"regexp_replace(regexp_replace(regexp_replace(lower({text}), 'https?://\S+|www\.\S+', '', 'g'), "
        rf"'\S+@\S+', '', 'g'), '[[:punct:]]', '', 'g')"
    )


# RE2 takes \b as ASCII, so stop words are removed as whole words after splitting; the texts have no symbol that
# would make a difference.
LETTERS = r"regexp_replace(w, '\p{Nd}+|[^\x{0000}-\x{024F}\x{1E00}-\x{1EFF}]', '', 'g')"


def kept_words(text: str, words=None) -> str:
    split = rf"string_split_regex({without_links(text)}, '\s+')"
    return f"list_filter({split}, lambda w: NOT list_contains({words_sql(words or stopwords())}, w))"


def tokens(text: str) -> str:
    letters = f"list_transform({kept_words(text)}, lambda w: {LETTERS})"
    return f"list_filter({letters}, lambda t: length(t) > 1)"


RULE = """CASE WHEN NOT ends_with(token, 's') THEN token
  WHEN regexp_matches(token, '[a-z]{2}ies$') THEN regexp_replace(token, 'ies$', 'y')
  WHEN regexp_matches(token, '[a-z](?:ss|sh|ch|x|z)es$') THEN regexp_replace(token, 'es$', '')
  WHEN regexp_matches(token, '[a-z][a-rt-z]s$') AND NOT regexp_matches(token, '(?:us|is)$')
  THEN regexp_replace(token, 's$', '') ELSE token END"""

IRREGULAR_ROWS = ", ".join(f"('{t}', '{lemma}')" for t, lemma in IRREGULAR.items())

# Tokens of documents by position, distinct tokens with their lemma, and lemmatised tokens.
TOKENS = f"""
lists AS (SELECT doc_id, source, lang, {tokens('text')} AS tokens FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM lists),
irregular(token, listed) AS (VALUES {IRREGULAR_ROWS}),
lemmas AS (
  SELECT token, coalesce(listed, {RULE}) AS lemma
  FROM (SELECT DISTINCT token FROM words) LEFT JOIN irregular USING (token)),
terms AS (SELECT doc_id, pos, lemma AS term FROM words JOIN lemmas USING (token))
"""

TFIDF = TOKENS + """,
n AS (SELECT count(*) AS n_docs FROM lists),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
idf AS (
  SELECT term, count(*) AS df, ln((1 + (SELECT n_docs FROM n)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
raw AS (SELECT doc_id, term, tf, tf * idf AS x FROM tf JOIN idf USING (term)),
norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY doc_id),
weights AS (SELECT doc_id, term, tf, x / norm AS w FROM raw JOIN norms USING (doc_id))
"""

# Given labels: the number of the source of English documents, noise for the rest.
DOC_LABELS = """
doc_labels AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN CAST(substr(source, 4) AS INTEGER) ELSE -1 END AS cluster FROM documents)
"""

VECTORS = """
vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb,
         list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS cosine,
         list_distance(a.v, b.v) AS d
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id)
"""
