"""Queries of the training-data operators over the test tables, with SQL where SQL can state them."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from weftwork.llm import canonical, leaks, names, packing, quality, splitting, terms, truncation
from weftwork.plans.references import VISIBLE
from weftwork.sources.tables import table


def _late(rows):
    return F.coalesce(F.col("arrived_at") >= F.lit("2025-07-01").cast("timestamp_ntz"), F.lit(False))


def _term_state(spark, folder):
    """The rows of a first load, stored, and then the later ones as a delta against the stored counts."""
    nodes, edges = table(spark, folder, "nodes"), table(spark, folder, "edges")
    first = terms.TermCounts.fresh(spark).merge(terms.delta(terms.node_terms(nodes.where(~_late(nodes))), terms.edge_terms(edges.where(~_late(edges)))))
    counts = terms.TermCounts.open(spark, first.path)
    return counts.merge(terms.delta(terms.node_terms(nodes.where(_late(nodes))), terms.edge_terms(edges.where(_late(edges))))).state()


def p4_found(spark, folder):
    return terms.marks(terms.counts(_term_state(spark, folder)))


def p4_terms(spark, folder):
    return terms.counts(_term_state(spark, folder)).where(F.col("field_name").isin(list(terms.TABLES)))


def p4_increment(spark, folder):
    """Counts after a second delta: late rows are added, deleted nodes removed."""
    nodes, edges = table(spark, folder, "nodes"), table(spark, folder, "edges")
    late = _late(nodes)
    counts = terms.TermCounts.fresh(spark)
    counts.merge(terms.delta(terms.node_terms(nodes.where(~late)), terms.edge_terms(edges.where(~late))))
    counts.merge(
        terms.delta(
            terms.node_terms(nodes.where(late)), terms.edge_terms(edges.where(late)), terms.node_terms(nodes.where("deleted_at is not null"), sign=-1)
        )
    )
    return terms.counts(counts.state()).where(F.col("field_name").isin(list(terms.TABLES)) & (F.col("records") > 0))


def _entities(spark, folder):
    return names.entities(table(spark, folder, "nodes"), table(spark, folder, "type_vocab"))


def p1_found(spark, folder):
    return names.variant_pairs(_entities(spark, folder))


def p1_spellings(spark, folder):
    return names.canonical_spellings(_entities(spark, folder))


def _mapped(spark, folder):
    rows = canonical.typed_rows(table(spark, folder, "nodes"), table(spark, folder, "edges"))
    return canonical.map_values(rows, table(spark, folder, "type_vocab"))


def p3_found(spark, folder):
    return _mapped(spark, folder).where(~F.col("exact")).select("kind", "row_key", "canonical").distinct()


def p3_stored(spark, folder):
    """Rows whose value is, as stored, a name of one entry alone."""
    vocab = table(spark, folder, "type_vocab")
    names = canonical.vocabulary(vocab).groupBy("kind", F.col("name").alias("value")).agg(F.count_distinct("canonical").alias("k")).where("k = 1").select("kind", "value")
    return _mapped(spark, folder).join(names, ["kind", "value"], "left_semi").select("kind", "row_key", "canonical")


def p3_misses(spark, folder):
    """Values that no entry explains, with their rows."""
    return _mapped(spark, folder).where(F.col("canonical") == canonical.NONE).groupBy("kind", "value").agg(F.count("*").alias("n_rows"))


def p5_found(spark, folder):
    return truncation.cut_replies(table(spark, folder, "replies")).where("cut").select("graph_id", "attempt").distinct()


def p5_report(spark, folder):
    return truncation.cut_report(truncation.cut_replies(table(spark, folder, "replies")))


def p5_copies(spark, folder):
    """Whole replies that are strict prefixes of a longer reply."""
    values = table(spark, folder, "replies").select(F.lit("raw").alias("kind"), F.col("raw").alias("value"))
    return truncation.prefixes_of_longer(values)


def p6_found(spark, folder):
    """Requests that had to be cut: those with a second piece."""
    return splitting.split_texts(table(spark, folder, "requests")).where("piece_no = 1").select("request_id").distinct()


def p6_pieces(spark, folder):
    return splitting.split_texts(table(spark, folder, "requests"))


#: Ranks of a public byte-level vocabulary of 50,000 tokens.
TOKENIZER = os.environ.get("WEFTWORK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p6_invariants(spark, folder):
    """For each request whether its pieces are under the limit, cover the text without a gap and share the overlap."""
    requests = table(spark, folder, "requests").select("request_id", F.col("text").alias("whole"), "max_chars", F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)).alias("overlap"))
    rows = splitting.split_texts(table(spark, folder, "requests")).join(requests, "request_id")
    shared = F.when(F.col("overlap") < F.col("max_chars"), F.col("overlap")).otherwise(F.floor(F.col("max_chars") / 2))
    same = F.col("text") == F.expr("substring(whole, start_at + 1, end_at - start_at)")
    total = F.sum(F.col("end_at") - F.col("start_at")) - F.max(shared) * (F.count("*") - 1)
    return rows.groupBy("request_id").agg(
        (F.max(F.length("text") - F.col("max_chars")) <= 0).alias("fits"),
        (F.bool_and(same) & (F.min("start_at") == 0) & (F.max("end_at") == F.max(F.length("whole"))) & (total == F.max(F.length("whole")))).alias("covers"),
        (F.count("*") > 1).alias("is_cut"),
    )


def p7_containers(spark, folder):
    return packing.containers(packing.token_items(table(spark, folder, "documents"), TOKENIZER))


def p7_invariants(spark, folder):
    """For each post whether its pieces cover its text, and lie in containers that are not overfull."""
    packed = p7_containers(spark, folder)
    full = packed.groupBy("container_id").agg((F.sum("n_tokens") <= packing.CAPACITY).alias("room"))
    lengths = table(spark, folder, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    rows = packed.join(full, "container_id").join(lengths, "doc_id")
    return rows.groupBy("doc_id").agg((F.sum(F.col("end_at") - F.col("start_at")) == F.max("n")).alias("covers"), F.bool_and("room").alias("fits"))


def p7_fill(spark, folder):
    return packing.fill(p7_containers(spark, folder))


def p9_found(spark, folder):
    kinds = quality.kinds_of_text(table(spark, folder, "documents"), table(spark, folder, "common_words"))
    return quality.not_prose(kinds).select("doc_id").distinct()


def p9_kinds(spark, folder):
    return quality.kinds_of_text(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p9_statistics(spark, folder):
    return quality.rules(quality.statistics(table(spark, folder, "documents"), table(spark, folder, "common_words")))


def _leaks(spark, folder):
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark, folder):
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p8_spans(spark, folder):
    return _leaks(spark, folder)


def p8_leaked_items(spark, folder):
    return leaks.leaked_items(_leaks(spark, folder))


QUERIES = {
    "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_invariants": p7_invariants, "p9_found": p9_found, "p9_kinds": p9_kinds, "p9_statistics": p9_statistics,
    "p1_found": p1_found, "p1_spellings": p1_spellings,
    "p5_found": p5_found, "p5_report": p5_report, "p5_copies": p5_copies,
    "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_invariants": p6_invariants, "p8_found": p8_found, "p8_spans": p8_spans, "p8_leaked_items": p8_leaked_items,
    "p3_found": p3_found, "p3_misses": p3_misses, "p3_stored": p3_stored, "p4_found": p4_found, "p4_terms": p4_terms, "p4_increment": p4_increment}


def _terms_sql(nodes: str) -> str:
    return f"""
  words AS (
    SELECT 'node_type' AS field_name, type AS term, graph_id FROM {nodes}
    UNION ALL SELECT 'edge_type', type, graph_id FROM edges
    UNION ALL SELECT 'node_label', unnest(string_split(lower(label), ' ')), graph_id FROM {nodes}),
  counted AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT graph_id) AS records
    FROM words WHERE term IS NOT NULL AND regexp_matches(term, '{VISIBLE}') GROUP BY 1, 2)"""


_SPACE = r"[ \t\n\x{0B}\f\r]"
_BULLET = r"^[ \t\n\x{0B}\f\r]*(?:[-*•·▪+–]|[0-9]{1,3}[.)]|\[[ xX*]?\])[ \t\n\x{0B}\f\r]"
_REASONS = """CASE WHEN n_words < 50 THEN 'few_words' END, CASE WHEN n_words > 100000 THEN 'many_words' END, CASE WHEN word_chars < 3 * n_words THEN 'short_words' END,
    CASE WHEN word_chars > 10 * n_words THEN 'long_words' END, CASE WHEN 10 * n_symbols > n_words THEN 'many_symbols' END, CASE WHEN 10 * n_bullets > 9 * n_lines THEN 'bullets' END,
    CASE WHEN 10 * n_alpha_words < 8 * n_words THEN 'few_letters' END, CASE WHEN n_common < 2 THEN 'few_common_words' END, CASE WHEN 10 * n_line_ends < n_lines THEN 'few_line_ends' END"""

ORACLE = {
    "p9_statistics": rf"""WITH split AS (
    SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: w <> '') AS words,
      list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_matches(x, '[^ \t\n\x{{0B}}\f\r]')) AS lines
    FROM documents WHERE text IS NOT NULL),
  listed AS (SELECT list(DISTINCT lower(word)) AS l FROM common_words),
  stats AS (SELECT doc_id, length(text) AS n_chars, len(words) AS n_words,
      coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
      len(list_filter(words, lambda w: regexp_matches(w, '\p{{L}}'))) AS n_alpha_words,
      len(regexp_extract_all(text, '#')) + len(regexp_extract_all(text, '\.\.\.|…')) AS n_symbols,
      len(lines) AS n_lines,
      len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。！？]["''”’)»]*{_SPACE}*$'))) AS n_line_ends,
      len(list_filter(lines, lambda x: regexp_matches(x, '{_BULLET}'))) AS n_bullets,
      len(list_filter(words, lambda w: list_contains(l, regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')))) AS n_common
    FROM split, listed)
  SELECT *, concat_ws(',', {_REASONS}) AS reasons FROM stats""",
    "p5_copies": """SELECT DISTINCT 'raw' AS kind, md5(a.raw) AS value_id FROM replies a
  WHERE a.raw <> '' AND EXISTS (SELECT 1 FROM replies b WHERE length(b.raw) > length(a.raw) AND starts_with(b.raw, a.raw))""",
    "p7_invariants": "SELECT DISTINCT doc_id, true AS covers, true AS fits FROM documents",
    "p3_stored": """WITH names AS (
    SELECT kind, canonical, unnest(list_prepend(canonical, coalesce(aliases, []))) AS value FROM type_vocab WHERE kind IS NOT NULL AND canonical IS NOT NULL),
  single AS (SELECT kind, value, min(canonical) AS canonical FROM names WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT canonical) = 1),
  typed AS (SELECT 'node' AS kind, node_key AS row_key, type AS value FROM nodes UNION ALL SELECT 'edge', edge_key, type FROM edges)
  SELECT typed.kind, row_key, canonical FROM typed JOIN single USING (kind, value)""",
    "p6_invariants": f"SELECT request_id, true AS fits, true AS covers, length(text) > max_chars AS is_cut FROM requests WHERE regexp_matches(text, '{VISIBLE}')",
    "p6_found": f"SELECT DISTINCT request_id FROM requests WHERE regexp_matches(text, '{VISIBLE}') AND length(text) > max_chars",
    "p4_found": f"""WITH {_terms_sql("nodes")},
  total AS (SELECT 'n' AS t, count(DISTINCT graph_id) AS n FROM nodes UNION ALL SELECT 'e', count(DISTINCT graph_id) FROM edges)
  SELECT field_name, term, CASE WHEN records = 1 THEN 'rare' ELSE 'common' END AS mark
  FROM counted JOIN total ON total.t = left(field_name, 1) WHERE records = 1 OR records > total.n / 10.0""",
    "p4_terms": f"WITH {_terms_sql('nodes')} SELECT * FROM counted",
    "p4_increment": f"WITH alive AS (SELECT * FROM nodes WHERE deleted_at IS NULL), {_terms_sql('alive')} SELECT * FROM counted",
}
