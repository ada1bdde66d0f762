"""The registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm import bytebpe, centroids, chat, decontaminate, divergence, extract, fingerprint, lmscore, mixing, neardup, secretscan, sharding, toxicity
from opsframe.llm.base import table


def op1_boosted_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract.extract(pages, extract.fit(pages))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    classes = neardup.near_classes(table(spark, sf_dir, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("keeper_node"))
    return classes.select("doc_id", "class_id", "class_size", kept.alias("kept"))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard by virtual slots, sizes near equal in bytes."""
    rows, _ = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op4_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a model that saw no held-out label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_chat_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(rows.unionByName(more))
    turns = chat.read_back(F.col("formatted"))
    said = F.concat_ws("", F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    digests = chats.withColumns({"said": said, "learnt": chat.loss_text(F.col("segments")), "back": F.size(turns).cast("long")})
    return digests.select(
        "conv_id",
        F.col("back").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid", "first_fault",
    )


def op6_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of the documents with what the forest makes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return secretscan.scan(docs, secretscan.fit(secretscan.labelled_findings(docs)))


def op7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return decontaminate.leak_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed, _ = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op9_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the documents labelled as good against one of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    return lmscore.cross_entropy_difference(docs, docs.join(good, "doc_id", "left_semi"))


def op10_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest beside that of its edited text and of the next document."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every embedding after five exact rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_perfect_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each lang stand from each other, and the terms that mark them."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and what they decode to, as digests."""
    import public_tokenizers

    vocabulary = bytebpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bytebpe.encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return bytebpe.decode(encoded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_boosted_dom": op1_boosted_dom,
    "op2_dart_minhash": op2_dart_minhash,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_counterfactual": op4_counterfactual,
    "op5_chat_machine": op5_chat_machine,
    "op6_forest": op6_forest,
    "op7_templates": op7_templates,
    "op8_sainte_lague": op8_sainte_lague,
    "op9_entropy_difference": op9_entropy_difference,
    "op10_improbable_features": op10_improbable_features,
    "op11_simplex_clusters": op11_simplex_clusters,
    "op12_perfect_recount": op12_perfect_recount,
    "op13_merge_replay": op13_merge_replay,
}

_ESCAPED = "replace({0}, '\\', '\\b')"
for _control, _code in zip(chat.INSTRUCT.control, chat.INSTRUCT.codes, strict=False):
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '\\{_code}')"

ORACLES: dict[str, str] = {
    "op5_chat_machine": f"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
 length({_ESCAPED.format('text')}) + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 18 WHEN 'assistant' THEN 11
  ELSE 17 + length({_ESCAPED.format('role')}) END AS chars FROM t),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS place, 'start' AS state, CAST(NULL AS BIGINT) AS fault FROM (SELECT DISTINCT conv_id FROM t)
 UNION ALL SELECT w.conv_id, n.place, CASE WHEN list_contains(['start>system','start>user','system>user','user>assistant','assistant>user'], w.state || '>' || n.role)
  THEN n.role ELSE w.state END, coalesce(w.fault, CASE WHEN NOT list_contains(['start>system','start>user','system>user','user>assistant','assistant>user'], w.state || '>' || n.role)
  THEN n.place END) FROM walk w JOIN n ON n.conv_id = w.conv_id AND n.place = w.place + 1),
ended AS (SELECT conv_id, coalesce(fault, CASE WHEN state NOT IN ('user','assistant') THEN place + 1 END) AS first_fault
 FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1)
SELECT n.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n.place)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n.place), '')) AS loss_sha256,
 CAST(sum(chars) AS BIGINT) AS formatted_chars, any_value(first_fault) IS NULL AS valid, any_value(first_fault) AS first_fault
 FROM n JOIN ended USING (conv_id) GROUP BY n.conv_id""",
    "op8_sainte_lague": """WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
 md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS full_size FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / sum(weight) OVER (ORDER BY full_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, CASE WHEN full_size <= level * weight THEN CAST(full_size AS DOUBLE) ELSE weight * (SELECT level FROM l WHERE full_size > level * weight
 ORDER BY full_size / weight, rank LIMIT 1) END AS target FROM l),
seats AS (SELECT source, count(*) AS seats FROM (SELECT source, rank, target / (2 * seat + 1) AS quotient, seat
 FROM t, unnest(range(0, CAST(target / 64 AS BIGINT) + 3)) AS u(seat) WHERE target > 0
 ORDER BY quotient DESC, rank, seat LIMIT (SELECT CAST(round(sum(source_size) / 64) AS BIGINT) FROM s)) GROUP BY source),
r AS (SELECT t.source, source_size, target, least(coalesce(seats, 0) * 64, full_size) AS run,
 CASE WHEN source_size > 0 THEN CAST('0x' || substr(md5('mix-1|' || coalesce(t.source, '-')), 1, 12) AS BIGINT) % source_size ELSE 0 END AS start
 FROM t LEFT JOIN seats ON seats.source IS NOT DISTINCT FROM t.source),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || digest || '|0'), doc_id, size
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d)
SELECT doc_id, p.source, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (run // source_size) * size
 + greatest(0, least(pos + size, least(start + run % source_size, source_size)) - greatest(pos, start))
 + greatest(0, least(pos + size, start + run % source_size - source_size) - pos) END AS BIGINT) AS taken
 FROM p JOIN r ON r.source IS NOT DISTINCT FROM p.source""",
}

ORACLES["op12_perfect_recount"] = """WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT DISTINCT id, lang, term FROM t) GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n FROM g JOIN k ON k.lang = g.lang
 LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
 FROM (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
 GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
 SELECT p.lang, p.source, 'term', p.term, p.p - l.q FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p.p > l.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
 FROM u QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50"""


def _clusters_sql(rounds: int = 5) -> str:
    """Start, rounds of assigning and moving, and a last assignment."""
    steps = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v AS c FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40)",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT vec_id, any_value(v) AS v, min(struct_pack(distance := distance, cluster := cluster)) AS best FROM (
 SELECT vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS distance
 FROM v CROSS JOIN c{i}) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM (
 SELECT best.cluster AS cluster, place, CAST(sum(v[place]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) AS r(place) GROUP BY ALL) GROUP BY cluster),
c{i + 1} AS (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.distance AS distance,
 CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.distance) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = best.cluster"""


ORACLES["op11_simplex_clusters"] = _clusters_sql()


def all_queries():
    """Each query with this package sent to the Python workers first."""
    from opsframe.session import ship_package

    def shipped(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(query) for name, query in QUERIES.items()}
