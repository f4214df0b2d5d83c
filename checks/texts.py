"""Sentiment, term weights, neighbours and word counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as b
from checks.registry import check
from tallyshelf.operators import neighbours, postings, sentiment, tfidf, wordcounts
from tallyshelf.plans import similar, tables
from tallyshelf.session import fresh_path
from tallyshelf.sources import files

# --- sentiment -------------------------------------------------------------------------------------------


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{word}'" for word in words)


def _step(value: str, near: str, weight: float) -> str:
    """SQL of one preceding word's effect on a valence."""
    word = f"lower({near})"
    loud = f"(CASE WHEN mixed AND upper({near}) = {near} AND lower({near}) <> {near} THEN 0.733 ELSE 0 END)"
    known = f"{word} IN (SELECT token FROM lexicon)"
    push = f"""CASE WHEN {known} THEN 0 WHEN {word} IN ({_quoted(sentiment.INTENSIFIERS)}) THEN (0.293 + {loud}) * {weight}
      WHEN {word} IN ({_quoted(sentiment.DAMPENERS)}) THEN ({loud} - 0.293) * {weight} ELSE 0 END"""
    turn = f"""CASE WHEN {known} THEN 1 WHEN {word} IN ({_quoted(sentiment.NEGATORS)}) OR contains({word}, 'n''t') THEN -0.74 ELSE 1 END"""
    return f"({value} + sign({value}) * ({push})) * ({turn})"


POLARITY = (
    b.LEXICON_SQL
    + r""",
pieces AS (
  SELECT key, [CASE WHEN length(regexp_replace(p, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')) <= 2 THEN p
      ELSE regexp_replace(p, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g') END
      for p in string_split_regex(text, '\s+') if p <> ''] AS words FROM texts),
spoken AS (
  SELECT key, words, coalesce(list_position([lower(w) for w in words], 'but'), 0) AS but_at,
    len([w for w in words if upper(w) = w AND lower(w) <> w]) BETWEEN 1 AND len(words) - 1 AS mixed FROM pieces),
placed AS (
  SELECT key, words, but_at, mixed, unnest(words) AS w0, unnest(range(1, len(words) + 1)) AS spot FROM spoken),
near AS (
  SELECT key, but_at, mixed, w0, spot, coalesce(CASE WHEN spot > 1 THEN words[spot - 1] END, '') AS w1,
    coalesce(CASE WHEN spot > 2 THEN words[spot - 2] END, '') AS w2,
    coalesce(CASE WHEN spot > 3 THEN words[spot - 3] END, '') AS w3 FROM placed),
v0 AS (
  SELECT near.*, """
    + f"""CASE WHEN lower(w0) IN ({_quoted(sentiment.INTENSIFIERS + sentiment.DAMPENERS)}) THEN 0 ELSE valence END AS base
  FROM near JOIN lexicon ON lower(w0) = token),
v1 AS (
  SELECT *, base + CASE WHEN mixed AND upper(w0) = w0 AND lower(w0) <> w0 THEN sign(base) * 0.733 ELSE 0 END AS a
  FROM v0),
v2 AS (SELECT *, {_step('a', 'w1', 1.0)} AS d1 FROM v1),
v3 AS (SELECT *, {_step('d1', 'w2', 0.95)} AS d2 FROM v2),
v4 AS (SELECT *, {_step('d2', 'w3', 0.9)} AS d3 FROM v3),
sums AS (
  SELECT key, sum(d3 * CASE WHEN but_at = 0 OR spot = but_at THEN 1 WHEN spot < but_at THEN 0.5 ELSE 1.5 END) AS total
  FROM v4 GROUP BY key),
polarity AS (SELECT key, round(CAST(coalesce(total, 0) AS DOUBLE), 6) + 0 AS polarity FROM texts LEFT JOIN sums USING (key))"""
)


@check(f"WITH texts AS (SELECT doc_id AS key, text FROM documents), {POLARITY} SELECT key AS doc_id, polarity FROM polarity")
def lexicon_polarity(spark, sf):
    docs = b.text_table(spark, sf)
    return sentiment.lexicon_polarity(docs, b.lexicon(spark), ["doc_id"], "text")


@check(
    f"""WITH texts AS (SELECT doc_id AS key, text FROM documents), {POLARITY}
    SELECT doc_id, CAST(CASE WHEN quality <> 1 THEN 0 WHEN polarity > 0 THEN 2 WHEN polarity < 0 THEN 0 ELSE 1 END AS INTEGER)
      AS sentiment_analysis
    FROM polarity JOIN documents ON key = documents.doc_id LEFT JOIN labels USING (doc_id)"""
)
def sentiment_label(spark, sf):
    labelled = sentiment.label_reviews(b.review_texts(spark, sf), b.lexicon(spark))
    return labelled.select("doc_id", "sentiment_analysis")


@check(
    f"""WITH texts AS (SELECT doc_id AS key, text FROM documents), {POLARITY}
    SELECT 'u' || doc_id AS user_id, doc_id AS item_id, quality = 1 AS recommend,
      CASE WHEN doc_id % 13 <> 0 THEN text ELSE 'no data' END AS review,
      CAST(CASE WHEN doc_id % 13 = 0 THEN 1 WHEN quality <> 1 THEN 0 WHEN polarity > 0 THEN 2 WHEN polarity < 0 THEN 0
        ELSE 1 END AS INTEGER) AS sentiment_analysis
    FROM polarity JOIN documents ON key = documents.doc_id LEFT JOIN labels USING (doc_id) WHERE doc_id % 41 <> 0 AND doc_id % 43 <> 0"""
)
def clean_reviews(spark, sf):
    return tables.clean_reviews(tables.flat_reviews(b.review_lines(spark, sf)), b.lexicon(spark))


@check(
    f"""WITH texts AS (SELECT doc_id AS key, CASE WHEN doc_id % 13 <> 0 THEN text ELSE 'no data' END AS text FROM documents), {POLARITY}
    SELECT 'u' || doc_id AS user_id, doc_id AS item_id, quality = 1 AS recommend, texts.text AS review,
      CAST(CASE WHEN quality <> 1 THEN 0 WHEN polarity > 0 THEN 2 WHEN polarity < 0 THEN 0 ELSE 1 END AS INTEGER) AS sentiment_analysis
    FROM polarity JOIN texts ON texts.key = polarity.key JOIN documents ON texts.key = documents.doc_id LEFT JOIN labels USING (doc_id)
    WHERE doc_id % 41 <> 0 AND doc_id % 43 <> 0"""
)
def clean_reviews_sentinel(spark, sf):
    """Missing texts are filled before they are scored."""
    return tables.clean_reviews(tables.flat_reviews(b.review_lines(spark, sf)), b.lexicon(spark), sentinel_first=True)


# phrases of the checks besides the published ones, and ends of texts that put every rule to use
MORE_PHRASES = [("best idiot", "idiom", -4.0), ("trash can", "idiom", 0.0), ("a stupid loser", "idiom", -1.0), ("really just", "booster", 0.293)]
ENDS = [
    "it is least stupid", "at least best day", "the least pathetic one", "he was never so stupid", "never did this moron",
    "there is no best", "no trash here", "without any doubt best", "without doubt best", "one kind of stupid thing", "a sort of best",
    "put it in the trash can", "it was the best idiot there", "not so NO best thing", "neither no one or best", "AND THE LEAST stupid loser",
    "he is really just scum", "was it a stupid loser",
]
PHRASES = [(p, "idiom", v) for p, v in sentiment.IDIOMS.items()] + [(p, "booster", v) for p, v in sentiment.PHRASE_BOOSTERS.items()] + MORE_PHRASES


def _phrase(kind: str, *names: str) -> str:
    """SQL of what a run of words is worth as a phrase."""
    words = " || ' ' || ".join(f"lower({name})" for name in names)
    return f"CASE {words} " + " ".join(f"WHEN '{p}' THEN {v}" for p, k, v in PHRASES if k == kind) + " END"


def _far_step(value: str, far: str, nearer: list[str], weight: float) -> str:
    """SQL of the effect of the second or third word before, with the rules for "never so" and "without doubt"."""
    plain = _step(value, far, weight)
    pushed, turned = plain.rsplit(" * (", 1)
    known = f"lower({far}) IN (SELECT token FROM lexicon)"
    so, doubt = (" OR ".join(f"lower({w}) IN ({words})" for w in nearer) for words in ("'so', 'this'", "'doubt'"))
    return f"""{pushed} * (CASE WHEN {known} THEN 1 WHEN lower({far}) = 'never' AND ({so}) THEN 1.25
      WHEN lower({far}) = 'without' AND ({doubt}) THEN 1 ELSE ({turned} END)"""


RUNS = [("w0", "n1", "n2"), ("w0", "n1"), ("w1", "w0"), ("w2", "w1", "w0"), ("w2", "w1"), ("w3", "w2", "w1"), ("w3", "w2")]
BOOSTING = [("w3", "w2", "w1"), ("w3", "w2"), ("w2", "w1")]
PHRASED = (
    POLARITY[: POLARITY.index("near AS (")]
    + r"""near AS (
  SELECT key, but_at, mixed, w0, spot, coalesce(CASE WHEN spot > 1 THEN words[spot - 1] END, '') AS w1,
    coalesce(CASE WHEN spot > 2 THEN words[spot - 2] END, '') AS w2, coalesce(CASE WHEN spot > 3 THEN words[spot - 3] END, '') AS w3,
    coalesce(words[spot + 1], '') AS n1, coalesce(words[spot + 2], '') AS n2 FROM placed),"""
    + f"""
v0 AS (
  SELECT near.*, lower(w0) IN ({_quoted(sentiment.INTENSIFIERS + sentiment.DAMPENERS)}) OR (lower(w0) = 'kind' AND lower(n1) = 'of') AS skipped,
    CASE WHEN lower(w1) = 'no' OR lower(w2) = 'no' OR (lower(w3) = 'no' AND lower(w1) IN ('or', 'nor')) THEN valence * -0.74
      WHEN lower(w0) = 'no' AND lower(n1) IN (SELECT token FROM lexicon) THEN 0 ELSE valence END AS base
  FROM near JOIN lexicon ON lower(w0) = token),
v1 AS (
  SELECT *, base + CASE WHEN mixed AND upper(w0) = w0 AND lower(w0) <> w0 THEN sign(base) * 0.733 ELSE 0 END AS a FROM v0),
v2 AS (SELECT *, {_step('a', 'w1', 1.0)} AS d1 FROM v1),
v3 AS (SELECT *, {_far_step('d1', 'w2', ['w1'], 0.95)} AS d2 FROM v2),
v4 AS (SELECT *, {_far_step('d2', 'w3', ['w2', 'w1'], 0.9)} AS d3 FROM v3),
v5 AS (
  SELECT *, CASE WHEN spot > 3 AND lower(w3) NOT IN (SELECT token FROM lexicon)
      THEN coalesce({', '.join(_phrase('idiom', *run) for run in RUNS)}, d3) + {' + '.join(f"coalesce({_phrase('booster', *run)}, 0)" for run in BOOSTING)}
      ELSE d3 END AS e FROM v4),
v6 AS (
  SELECT *, CASE WHEN skipped THEN 0 WHEN lower(w1) = 'least' AND lower(w2) NOT IN ('at', 'very') THEN e * -0.74 ELSE e END AS f FROM v5),
sums AS (
  SELECT key, sum(f * CASE WHEN but_at = 0 OR spot = but_at THEN 1 WHEN spot < but_at THEN 0.5 ELSE 1.5 END) AS total
  FROM v6 GROUP BY key),
polarity AS (SELECT key, round(CAST(coalesce(total, 0) AS DOUBLE), 6) + 0 AS polarity FROM texts LEFT JOIN sums USING (key))"""
)
END_SQL = " ".join(f"WHEN {i} THEN '{end}'" for i, end in enumerate(ENDS))


@check(
    f"""WITH texts AS (SELECT doc_id AS key, text || ' ' || CASE doc_id % {len(ENDS)} {END_SQL} END AS text FROM documents), {PHRASED}
    SELECT key AS doc_id, polarity FROM polarity"""
)
def phrase_polarity(spark, sf):
    """Documents whose last words put the rules for runs of words to use."""
    ends = F.array(*map(F.lit, ENDS))
    text = F.concat("text", F.lit(" "), F.element_at(ends, (F.col("doc_id") % len(ENDS) + 1).cast("int")))
    phrases = sentiment.published_phrases(spark).unionByName(spark.createDataFrame(MORE_PHRASES, "phrase string, kind string, value double"))
    docs = b.text_table(spark, sf).withColumn("text", text)
    return sentiment.lexicon_polarity(docs, b.lexicon(spark), ["doc_id"], "text", phrases=phrases)


# --- term weights and neighbours --------------------------------------------------------------------------

WEIGHTS = r"""tf AS (
  SELECT id, term, count(*) AS tf FROM (
    SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM docs) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (
  SELECT id, term, df, tf * (ln((1.0 + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
vectors AS (SELECT id, term, df, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""

NEAREST = """dots AS (
  SELECT a.id, z.id AS neighbour, round(sum(a.weight * z.weight), 6) AS similarity
  FROM vectors a JOIN vectors z USING (term) WHERE a.id <> z.id AND a.id IN (SELECT id FROM wanted) GROUP BY ALL),
pairs AS (
  SELECT a.id, z.id AS neighbour, coalesce(similarity, 0) AS similarity
  FROM wanted a JOIN docs z ON a.id <> z.id LEFT JOIN dots ON dots.id = a.id AND dots.neighbour = z.id),
nearest AS (
  SELECT id, neighbour, similarity,
    CAST(row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS INTEGER) AS place
  FROM pairs QUALIFY place <= 5)"""

DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"


@check(f"WITH {DOCS}, {WEIGHTS} SELECT id, term, df, round(weight, 6) AS weight FROM vectors")
def tfidf_vectors(spark, sf):
    vectors = tfidf.tfidf_vectors(b.documents(spark, sf))
    return vectors.select("id", "term", "df", F.round("weight", 6).alias("weight"))


@check(f"WITH {DOCS}, {WEIGHTS}, wanted AS (SELECT id FROM docs WHERE id % 20 = 0), {NEAREST} SELECT * FROM nearest")
def knn_cosine(spark, sf):
    """The nearest documents of a list of requested ones."""
    docs = b.documents(spark, sf)
    wanted = docs.select("id").where("id % 20 = 0")
    return neighbours.nearest_to(docs.select("id"), _stored(spark, tfidf.tfidf_vectors(docs)), wanted)


MODEL = f"""{b.GAMES}, model AS (
  SELECT id, title, trim(lower(regexp_replace(title, '[^a-zA-Z0-9 ]', ' ', 'g'))) AS normalized_title,
    concat_ws(' ', array_to_string(genres, ' '), array_to_string(specs, ' '), array_to_string(tags, ' '), title) AS text
  FROM games),
docs AS (SELECT id, text FROM model)"""
TITLED = """SELECT nearest.id, place, neighbour, model.title AS similar_title, similarity
  FROM nearest JOIN model ON neighbour = model.id"""


def _model(spark, sf):
    model = _stored(spark, tables.model_table(b.games(spark, sf)))
    return model, _stored(spark, similar.model_vectors(model))


def _stored(spark, df):
    """The table as written once and read by each request."""
    return files.stored(df, "stored")


@check(
    f"""WITH {MODEL}, {WEIGHTS}, wanted AS (SELECT min(id) AS id FROM model WHERE normalized_title = 'blue gizmo'),
    {NEAREST} {TITLED}"""
)
def similar_titles(spark, sf):
    return similar.similar_titles(*_model(spark, sf), "Blue-Gizmo!")


@check(
    f"""WITH {MODEL}, {WEIGHTS}, wanted AS (SELECT min(id) AS id FROM model
      WHERE normalized_title IN (SELECT lower(p_name) FROM part) GROUP BY normalized_title), {NEAREST} {TITLED}"""
)
def similar_titles_requested(spark, sf):
    titles = b.table(spark, sf, "part").select(F.upper("p_name").alias("title"))
    return similar.similar_to_titles(*_model(spark, sf), titles)


# --- word counts -----------------------------------------------------------------------------------------

# stop words of the checks
STOP = ["the", "of", "de", "and", "to", "in", "la", "der", "is", "that"]
FIELDS = {
    "genres": "array_to_string(genres, ' ')",
    "developer": "developer",
    "title": "title",
    "tags": "array_to_string(tags, ' ')",
    "specs": "array_to_string(specs, ' ')",
}
FIELD_TEXTS = "texts AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS field, id, {text} AS text FROM games" for name, text in FIELDS.items()
) + ")"
FIELD_WORDS = r"""listed AS (
  SELECT field, id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS words FROM texts)"""


def _top_units(unit: str) -> str:
    return f"""SELECT field, {unit}, n, place FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, {unit}) AS INTEGER) AS place
      FROM (SELECT field, {unit}, count(*) AS n FROM each GROUP BY ALL)) WHERE place <= 200"""


EACH_WORD = f"each AS (SELECT * FROM (SELECT field, unnest(words) AS word FROM listed) WHERE word NOT IN ({_quoted(STOP)}))"
EACH_PAIR = f"""each AS (SELECT field, a || ' ' || z AS bigram FROM (
  SELECT field, unnest(words[:-2]) AS a, unnest(words[2:]) AS z FROM listed WHERE len(words) > 1)
  WHERE a NOT IN ({_quoted(STOP)}) AND z NOT IN ({_quoted(STOP)}))"""
DOC_TEXTS = "texts AS (SELECT 'text' AS field, doc_id AS id, text FROM documents)"


@check(f"WITH {b.GAMES}, {FIELD_TEXTS}, {FIELD_WORDS}, {EACH_WORD} {_top_units('word')}")
def word_frequency(spark, sf):
    return wordcounts.word_frequency(b.games(spark, sf), list(FIELDS), STOP)


@check(f"WITH {DOC_TEXTS}, {FIELD_WORDS}, {EACH_WORD} {_top_units('word')}")
def word_frequency_documents(spark, sf):
    return wordcounts.word_frequency(b.text_table(spark, sf), ["text"], STOP)


@check(f"WITH {b.GAMES}, {FIELD_TEXTS}, {FIELD_WORDS}, {EACH_PAIR} {_top_units('bigram')}")
def bigram_frequency(spark, sf):
    return wordcounts.bigram_frequency(b.games(spark, sf), list(FIELDS), STOP)


@check(f"WITH {DOC_TEXTS}, {FIELD_WORDS}, {EACH_PAIR} {_top_units('bigram')}")
def bigram_frequency_documents(spark, sf):
    return wordcounts.bigram_frequency(b.text_table(spark, sf), ["text"], STOP)


# --- posting lists -----------------------------------------------------------------------------------------


def _postings(spark, vectors):
    path = fresh_path(spark, "postings")
    postings.write_postings(vectors, path)
    return path


@check(f"WITH {DOCS}, {WEIGHTS}, wanted AS (SELECT id FROM docs WHERE id % 20 = 0), {NEAREST} SELECT * FROM nearest")
def knn_cosine_postings(spark, sf):
    """The nearest documents of a list of requested ones, by lists with bounds."""
    docs = b.documents(spark, sf)
    path = _postings(spark, tfidf.tfidf_vectors(docs))
    return postings.nearest_by_postings(spark, path, docs.select("id"), docs.select("id").where("id % 20 = 0"))


@check(
    f"""WITH {MODEL}, {WEIGHTS}, wanted AS (SELECT min(id) AS id FROM model
      WHERE normalized_title IN (SELECT lower(p_name) FROM part) GROUP BY normalized_title), {NEAREST} {TITLED}"""
)
def similar_titles_postings(spark, sf):
    """Similar titles for all names of the catalogue, by lists with bounds."""
    model = _stored(spark, tables.model_table(b.games(spark, sf)))
    path = _postings(spark, similar.model_vectors(model))
    return similar.similar_to_titles(model, None, b.table(spark, sf, "part").select(F.upper("p_name").alias("title")), postings=path)


@check(
    f"""WITH {MODEL}, {WEIGHTS}, wanted AS (SELECT min(id) AS id FROM model WHERE normalized_title = 'blue gizmo'),
    {NEAREST} {TITLED}"""
)
def similar_title_postings(spark, sf):
    """Similar titles for one name, whose lists are looked up."""
    model = _stored(spark, tables.model_table(b.games(spark, sf)))
    return similar.similar_titles(model, None, "Blue-Gizmo!", postings=_postings(spark, similar.model_vectors(model)))


# --- collocations --------------------------------------------------------------------------------------------


def _folded(unit: str, table: str) -> str:
    """SQL: counts with the standard form of a plural, if its singular occurs in the field."""
    return f"""SELECT x.*, coalesce(z.{unit}, x.{unit}) AS standard FROM {table} x LEFT JOIN {table} z
      ON z.field = x.field AND suffix(x.{unit}, 's') AND NOT suffix(x.{unit}, 'ss') AND z.{unit} = left(x.{unit}, length(x.{unit}) - 1)"""


def _likelihood(k: str, n: str, x: str) -> str:
    return f"(ln(greatest({x}, 1e-10::DOUBLE)) * {k} + ln(greatest(1 - {x}, 1e-10::DOUBLE)) * ({n} - {k}))"


COLLOCATED = f"""each_word AS (SELECT * FROM (SELECT field, unnest(words) AS word FROM listed) WHERE word NOT IN ({_quoted(STOP)})),
w AS (SELECT field, word, count(*) AS n FROM each_word GROUP BY ALL), wf AS ({_folded('word', 'w')}),
c AS (SELECT field, standard, CAST(sum(n) AS DOUBLE) AS n FROM wf GROUP BY ALL), t AS (SELECT field, sum(n) AS total FROM c GROUP BY field),
each_pair AS (SELECT field, a || ' ' || z AS pair FROM (
  SELECT field, unnest(words[:-2]) AS a, unnest(words[2:]) AS z FROM listed WHERE len(words) > 1)
  WHERE a NOT IN ({_quoted(STOP)}) AND z NOT IN ({_quoted(STOP)})),
p AS (SELECT field, pair, count(*) AS n FROM each_pair GROUP BY ALL), pf AS ({_folded('pair', 'p')}),
pc AS (SELECT field, split_part(standard, ' ', 1) AS a, split_part(standard, ' ', 2) AS b, CAST(sum(n) AS DOUBLE) AS c12 FROM pf GROUP BY ALL),
met AS (
  SELECT pc.*, fa.standard AS a_word, fb.standard AS b_word, ca.n AS c1, cb.n AS c2, total, cb.n / total AS q, c12 / ca.n AS q1,
    CASE WHEN total > ca.n THEN (cb.n - c12) / (total - ca.n) END AS q2
  FROM pc JOIN wf fa ON fa.field = pc.field AND fa.word = a JOIN wf fb ON fb.field = pc.field AND fb.word = b
  JOIN c ca ON ca.field = pc.field AND ca.standard = fa.standard JOIN c cb ON cb.field = pc.field AND cb.standard = fb.standard
  JOIN t ON t.field = pc.field),
kept AS (
  SELECT * FROM (SELECT *, CASE WHEN total <= c1 OR total <= c2 THEN 0 ELSE -2 * (
      {_likelihood('c12', 'c1', 'q')} + {_likelihood('(c2 - c12)', '(total - c1)', 'q')}
      - {_likelihood('c12', 'c1', 'q1')} - {_likelihood('(c2 - c12)', '(total - c1)', 'q2')}) END AS score FROM met) WHERE score > 30)"""
UNITS = """taken AS (SELECT field, standard, sum(n) AS taken FROM (
    SELECT field, a_word AS standard, c12 AS n FROM kept UNION ALL SELECT field, b_word, c12 FROM kept) GROUP BY ALL),
units AS (
  SELECT field, standard AS unit, n - coalesce(taken, 0) AS n FROM c LEFT JOIN taken USING (field, standard)
  UNION ALL SELECT field, a || ' ' || b, c12 FROM kept)
SELECT field, unit, CAST(n AS BIGINT) AS n, place FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, unit) AS INTEGER) AS place FROM units WHERE n > 0) WHERE place <= 200"""


@check(f"WITH {DOC_TEXTS}, {FIELD_WORDS}, {COLLOCATED} SELECT field, a, b, a_word, b_word, CAST(c12 AS BIGINT) AS n, round(score, 4) AS score FROM kept")
def collocations(spark, sf):
    found = wordcounts.collocations(b.text_table(spark, sf), ["text"], STOP)
    return found.withColumn("score", F.round("score", 4))


@check(f"WITH {b.GAMES}, {FIELD_TEXTS}, {FIELD_WORDS}, {COLLOCATED}, {UNITS}")
def word_and_collocation_frequency(spark, sf):
    return wordcounts.word_and_collocation_frequency(b.games(spark, sf), list(FIELDS), STOP)
