"""Queries of the core operators over whole test tables, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import paths, symbols
from quillspan.functions import text as tx
from quillspan.operators import budget, emit, frontend, graph, manifest, paste, report, resolve, scoped, similarity, symbolgraph, validate
from quillspan.operators import catalog as cat
from quillspan.session import cut
from quillspan.sources import files as source

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "file_infos").select("repo", F.col("path").alias("node")).distinct()


def _edges(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "import_edges").select("repo", F.col("from_path").alias("src"), F.col("to_path").alias("dst"), "kind", "specifier")


def _internal(s: SparkSession, d: str) -> DataFrame:
    return graph.internal_edges(_edges(s, d), _nodes(s, d))


def _seeds(s: SparkSession, d: str) -> DataFrame:
    return _internal(s, d).groupBy("repo").agg(F.min("src").alias("node"))


# --- SQL shared by several queries ----------------------------------------------------------------------------------

_EXT = "lower(split_part(path, '.', -1))"
# Fixed values, spelled out again so that the SQL does not depend on what it is held against.
_CONFIG = "'json', 'yaml', 'yml', 'toml', 'ini', 'cfg', 'config', 'eslintrc', 'prettierrc', 'gitignore', 'dockerignore'"
_DOCS = "'md', 'txt', 'rst', 'adoc'"
_SOURCES = "'ts', 'tsx', 'js', 'jsx', 'py', 'rs', 'go', 'java', 'c', 'cpp', 'h', 'hpp', 'cs', 'rb', 'php', 'kt', 'swift', 'dart', 'scala', 'clj'"
_BINARIES = (
    "'exe', 'bin', 'dll', 'so', 'dylib', 'a', 'lib', 'o', 'obj', 'png', 'jpg', 'jpeg', 'gif', 'bmp', 'webp', 'ico', 'mp3', 'mp4', 'avi', 'mov', 'wmv', 'flv', 'wav', 'ogg', "
    "'zip', 'tar', 'gz', 'rar', '7z', 'bz2', 'xz', 'pdf', 'doc', 'docx', 'xls', 'xlsx', 'ppt', 'pptx', 'woff', 'woff2', 'ttf', 'otf', 'eot'"
)
_KIND = f"""CASE WHEN lower(path) LIKE '%test%' OR lower(path) LIKE '%spec%' THEN 'test'
    WHEN {_EXT} IN ({_CONFIG}) OR lower(path) LIKE '%config%' THEN 'config'
    WHEN {_EXT} IN ({_DOCS}) OR lower(path) LIKE '%readme%' OR lower(path) LIKE '%doc%' THEN 'docs'
    WHEN {_EXT} IN ({_SOURCES}) THEN 'code' ELSE 'asset' END"""
_BUCKET = """CASE WHEN lower(path) LIKE '%internal%' OR lower(path) LIKE '%private%' THEN 'internal'
    WHEN lower(path) LIKE '%public%' OR lower(path) LIKE '%api%' OR lower(path) LIKE '%contracts%' THEN 'public' ELSE 'unknown' END"""
_MANIFEST = f"""m0 AS (SELECT file_id, repo, path, bytes, loc, {_KIND} AS kind, {_BUCKET} AS bucket FROM file_infos WHERE {_EXT} NOT IN ({_BINARIES})),
m AS (SELECT *, (1000 + CASE kind WHEN 'code' THEN 100 WHEN 'config' THEN 80 WHEN 'docs' THEN 60 WHEN 'test' THEN 40 ELSE 20 END
    + CASE bucket WHEN 'public' THEN 50 WHEN 'internal' THEN 30 ELSE 0 END
    + CASE WHEN contains(lower(path), 'index.') OR contains(lower(path), 'main.') THEN 100 ELSE 0 END
    + CASE WHEN contains(lower(path), 'config') OR contains(lower(path), 'package.json') THEN 80 ELSE 0 END
    - CASE WHEN bytes > 100000 THEN 200 ELSE 0 END)::BIGINT AS importance FROM m0)"""
_GRAPH = """n AS (SELECT DISTINCT repo, path AS node FROM file_infos),
a AS (SELECT repo, from_path AS src, to_path AS dst, kind, specifier FROM import_edges),
e AS (SELECT DISTINCT repo, src, dst FROM a WHERE (repo, src) IN (SELECT repo, node FROM n) AND (repo, dst) IN (SELECT repo, node FROM n))"""
_DEGREES = (
    _GRAPH
    + """,
deg AS (SELECT n.repo, n.node, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM n
    LEFT JOIN (SELECT repo, dst, count(DISTINCT src) AS c FROM e GROUP BY ALL) i ON i.repo = n.repo AND i.dst = n.node
    LEFT JOIN (SELECT repo, src, count(DISTINCT dst) AS c FROM e GROUP BY ALL) o ON o.repo = n.repo AND o.src = n.node)"""
)
_PACKAGE = "CASE WHEN regexp_matches(specifier, '^(\\./|\\.\\./|/)') THEN '' ELSE regexp_extract(specifier, '^(@[^/]+/[^/]+|[^/]+)', 1) END"
_HUBS = """d AS (SELECT DISTINCT repo, src, dst, specifier, kind FROM a),
hubs AS (SELECT repo, src AS node, count(*) FILTER (WHERE kind IN ('reexport', 'export')) AS reexports, count(*) AS edges_total FROM d GROUP BY ALL
    HAVING count(*) FILTER (WHERE kind IN ('reexport', 'export')) >= 5)"""
_FANS = """fi AS (SELECT repo, node, in_degree AS n, row_number() OVER (PARTITION BY repo ORDER BY in_degree DESC, node) AS rank FROM deg WHERE in_degree > 0 QUALIFY rank <= 10),
fo AS (SELECT repo, node, out_degree AS n, row_number() OVER (PARTITION BY repo ORDER BY out_degree DESC, node) AS rank FROM deg WHERE out_degree > 0 QUALIFY rank <= 10)"""
_SPOTS = """u AS (SELECT repo, node, CASE WHEN n >= 10 THEN n ELSE 0 END AS score, CASE WHEN n >= 10 THEN 'fan-in' END AS reason, rank AS pos FROM fi
    UNION ALL SELECT repo, node, CASE WHEN n >= 10 THEN n ELSE 0 END, CASE WHEN n >= 10 THEN 'fan-out' END, 1000000 + rank FROM fo
    UNION ALL SELECT repo, node, reexports, 're-exports', 2000000 + row_number() OVER (PARTITION BY repo ORDER BY reexports DESC, node) FROM hubs),
spots AS (SELECT repo, node, sum(score)::BIGINT AS score, list_sort(list(reason) FILTER (WHERE reason IS NOT NULL)) AS reasons, min(pos) AS pos FROM u GROUP BY ALL),
hot AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, pos) AS rank FROM spots QUALIFY rank <= 20)"""
_SCC = """e0 AS (SELECT * FROM e WHERE src <> dst),
r(repo, x, y) AS (SELECT repo, src, dst FROM e0 UNION SELECT r.repo, r.x, e0.dst FROM r JOIN e0 ON e0.repo = r.repo AND e0.src = r.y),
scc AS (SELECT p.repo, p.x AS node, min(p.y) AS component FROM r p JOIN r q ON p.repo = q.repo AND p.x = q.y AND p.y = q.x GROUP BY ALL)"""
_NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '/\*.*?\*/', '', 'gs'),
    '//[^\r\n]*', '', 'g'), '#[^\r\n]*', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), '(?m)^import[ \t]+[^\r\n]*', '', 'g'), '(?m)^from[ \t]+[^\r\n]*import[ \t]+[^\r\n]*', '', 'g'), '(?m)^use[ \t]+[^\r\n]*', '', 'g'))"""
_PRINTS = f"""docs2 AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000, text || ' kept for ' || coalesce(source, 'nobody') FROM documents),
d0 AS (SELECT doc_id AS id, length(text) AS size, {_NORMAL.format(t="text")} AS n FROM docs2 WHERE text IS NOT NULL),
d1 AS (SELECT *, string_split(n, ' ') AS w FROM d0 WHERE length(n) >= 100),
prints AS (SELECT *, min(id) OVER (PARTITION BY n) AS rep FROM d1 WHERE len(w) - 4 >= 10),
sh AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM prints WHERE id = rep)),
cnt AS (SELECT id, count(*) AS k FROM sh GROUP BY id),
bth AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
pairs AS (SELECT a, b, c / (p.k + q.k - c) AS similarity FROM bth JOIN cnt p ON p.id = a JOIN cnt q ON q.id = b WHERE c / (p.k + q.k - c) >= 0.8)"""
_CLUSTERS = """nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM (SELECT a AS id FROM pairs UNION SELECT b FROM pairs)),
nb AS (SELECT b AS id, list(a) AS l FROM pairs GROUP BY b),
walk(rn, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
    SELECT nodes.rn, CASE WHEN nb.l IS NULL OR NOT list_has_any(nb.l, leaders) THEN list_append(leaders, nodes.id) ELSE leaders END
    FROM walk JOIN nodes ON nodes.rn = walk.rn + 1 LEFT JOIN nb ON nb.id = nodes.id),
lead AS (SELECT unnest(leaders) AS id FROM (SELECT leaders FROM walk ORDER BY rn DESC LIMIT 1)),
members AS (SELECT b AS id, min(a) AS leader FROM pairs WHERE a IN (SELECT id FROM lead) AND b NOT IN (SELECT id FROM lead) GROUP BY b),
clusters AS (SELECT leader, count(*) AS k, sum(p.size) AS chars, avg(similarity) AS sim FROM members m JOIN prints p ON p.id = m.id JOIN pairs ON a = leader AND b = m.id GROUP BY leader)"""


# --- Manifest -------------------------------------------------------------------------------------------------------


@query(f"WITH {_MANIFEST} SELECT * FROM m")
def file_manifest(s: SparkSession, d: str) -> DataFrame:
    return manifest.manifest(_t(s, d, "file_infos")).select("file_id", "repo", "path", "bytes", "loc", "kind", "bucket", "importance")


@query(f"WITH {_MANIFEST} SELECT kind, bucket, count(*) AS n_files, sum(coalesce(bytes, 0))::BIGINT AS total_bytes, sum(coalesce(loc, 0))::BIGINT AS total_loc FROM m GROUP BY kind, bucket")
def kind_bucket_counts(s: SparkSession, d: str) -> DataFrame:
    return manifest.summary(manifest.manifest(_t(s, d, "file_infos")))


@query("SELECT * FROM file_infos QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY loaded_at DESC NULLS LAST, file_id DESC) = 1")
def file_latest(s: SparkSession, d: str) -> DataFrame:
    return manifest.latest(_t(s, d, "file_infos"), ["repo", "path"], [F.desc_nulls_last("loaded_at"), F.desc("file_id")])


@query(
    f"""WITH RECURSIVE {_MANIFEST},
    o AS (SELECT repo, file_id, coalesce(bytes, 0) AS b, row_number() OVER (PARTITION BY repo ORDER BY importance DESC, path, file_id) AS rn FROM m),
    f(repo, rn, file_id, used, included) AS (SELECT repo, rn, file_id, CASE WHEN b <= 100000 THEN b ELSE 0 END, b <= 100000 FROM o WHERE rn = 1
        UNION ALL SELECT o.repo, o.rn, o.file_id, CASE WHEN used + b <= 100000 THEN used + b ELSE used END, used + b <= 100000 FROM f JOIN o ON o.repo = f.repo AND o.rn = f.rn + 1)
    SELECT file_id, included FROM f"""
)
def budget_first_fit(s: SparkSession, d: str) -> DataFrame:
    m = manifest.manifest(_t(s, d, "file_infos")).select("file_id", "repo", "path", "bytes", "importance")
    return manifest.first_fit(m, "repo", [F.desc("importance"), F.col("path"), F.col("file_id")], {"bytes": 100_000}).select("file_id", "included")


@query(
    """SELECT paste_id, sum(coalesce(size, 0)) OVER w <= 60000 AND row_number() OVER w <= 50 AS included FROM paste_files
    WINDOW w AS (PARTITION BY repo ORDER BY path, paste_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def budget_stop(s: SparkSession, d: str) -> DataFrame:
    return manifest.stop_at_overflow(_t(s, d, "paste_files"), "repo", [F.col("path"), F.col("paste_id")], "size", 60_000, 50).select("paste_id", "included")


@query(
    """SELECT repo, packages[1:greatest(1, floor(len(packages) * 24 / (len(packages) * 8))::INT)] AS packages FROM repos WHERE packages IS NOT NULL AND len(packages) * 8 > 24
    UNION ALL SELECT repo, packages FROM repos WHERE packages IS NOT NULL AND len(packages) * 8 <= 24"""
)
def budget_slice(s: SparkSession, d: str) -> DataFrame:
    r = _t(s, d, "repos").where("packages is not null")
    return r.select("repo", tx.array_downsample("packages", F.size("packages") * 8, 24).alias("packages"))


# --- Text -----------------------------------------------------------------------------------------------------------


@query(
    """SELECT paste_id, (length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS utf16, strlen(content)::BIGINT AS n_bytes,
    (CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END)::BIGINT AS n_lines,
    CASE WHEN strlen(content) > 50000 THEN 'skipped-large-file' ELSE sha256(content) END AS sha256, md5(content)[1:8] AS md5 FROM paste_files"""
)
def content_stats(s: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _t(s, d, "paste_files").select(
        "paste_id", tx.utf16_length(c).alias("utf16"), F.octet_length(c).cast("bigint").alias("n_bytes"), tx.line_count(c).alias("n_lines"), tx.content_hash(c, F.octet_length(c), 50_000).alias("sha256"), tx.short_md5(c).alias("md5")
    )


@query(
    """SELECT repo, sum(n)::BIGINT AS chars, ceil(sum(n) / 3)::BIGINT AS conservative, ceil(sum(n) / 5)::BIGINT AS optimistic,
    floor((ceil(sum(n) / 3) + ceil(sum(n) / 5)) / 2 + 0.5)::BIGINT AS average FROM (SELECT repo, coalesce(length(content), 0) AS n FROM paste_files) GROUP BY repo"""
)
def token_estimates(s: SparkSession, d: str) -> DataFrame:
    g = _t(s, d, "paste_files").groupBy("repo").agg(F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars"))
    return g.select("repo", "chars", tx.tokens_conservative("chars").alias("conservative"), tx.tokens_optimistic("chars").alias("optimistic"), tx.tokens_average("chars").alias("average"))


@query(f"SELECT paste_id, md5({_NORMAL.format(t='content')}) AS md5 FROM paste_files WHERE content IS NOT NULL")
def text_normalized(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "paste_files").where("content is not null").select("paste_id", F.md5(tx.normalized("content")).alias("md5"))


@query(
    f"""WITH a AS (SELECT doc_id, string_split({_NORMAL.format(t="text")}, ' ') AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, greatest(len(w) - 4, 0)::BIGINT AS n, CASE WHEN len(w) < 5 THEN NULL ELSE md5(array_to_string(w[1:5], ' '))[1:8] END AS first FROM a"""
)
def shingle_sets(s: SparkSession, d: str) -> DataFrame:
    sh = _t(s, d, "documents").where("text is not null").select("doc_id", tx.shingles(tx.normalized("text")).alias("s"))
    return sh.select("doc_id", F.size("s").cast("bigint").alias("n"), F.get("s", F.lit(0)).alias("first"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(s: SparkSession, d: str) -> DataFrame:
    return similarity.exact_duplicates(_t(s, d, "documents"), "doc_id", "text")


def _with_variants(s: SparkSession, d: str) -> DataFrame:
    """All documents, and each once more with a few words behind it: the tables hold no near-duplicates of their own."""
    t = _t(s, d, "documents").select("doc_id", "text", "source")
    return t.select("doc_id", "text").unionByName(t.select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.concat("text", F.lit(" kept for "), F.coalesce("source", F.lit("nobody"))).alias("text")))


def _prints(s: SparkSession, d: str) -> DataFrame:
    return similarity.fingerprints(_with_variants(s, d), "doc_id", "text")


@query(f"WITH {_PRINTS} SELECT a, b, similarity FROM pairs")
def similar_pairs(s: SparkSession, d: str) -> DataFrame:
    return similarity.similar_pairs(_prints(s, d))


@query(
    f"""WITH {_PRINTS}, size AS (SELECT rep, count(*) AS k FROM prints GROUP BY rep),
    ends AS (SELECT a AS rep, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs),
    l AS (SELECT ends.rep, sum(k)::BIGINT AS n FROM ends JOIN size ON size.rep = other GROUP BY ends.rep)
    SELECT p.id, p.rep AS class_id, coalesce(l.n, 0)::BIGINT AS n_links FROM prints p LEFT JOIN l ON l.rep = p.rep"""
)
def similar_links(s: SparkSession, d: str) -> DataFrame:
    p = _prints(s, d)
    return similarity.links(p, similarity.similar_pairs(p))


@query(f"WITH RECURSIVE {_PRINTS}, {_CLUSTERS} SELECT id, leader FROM members")
def dup_clusters(s: SparkSession, d: str) -> DataFrame:
    return similarity.greedy_clusters(similarity.similar_pairs(_prints(s, d))).select("id", "leader")


@query(
    f"""WITH RECURSIVE {_PRINTS}, {_CLUSTERS} SELECT count(*) AS n_clusters, coalesce(sum(k + 1), 0)::BIGINT AS in_clusters, coalesce(sum(chars + p.size), 0)::BIGINT AS cluster_chars,
    coalesce(max(k + 1), 0)::BIGINT AS largest, (SELECT count(*) FROM docs2) AS n_docs, coalesce(sum(k + 1), 0) / (SELECT count(*) FROM docs2) AS ratio
    FROM clusters JOIN prints p ON p.id = leader"""
)
def dup_summary(s: SparkSession, d: str) -> DataFrame:
    p = _prints(s, d)
    c = similarity.cluster_table(similarity.greedy_clusters(similarity.similar_pairs(p)), p)
    return similarity.duplication_summary(_with_variants(s, d), c)


_SECRETS = (  # what docs call secrets, spelled out again
    ("PEM_BLOCK", "", r"-----BEGIN [A-Z0-9 ]+-----[^-]*(?:-----END [A-Z0-9 ]+-----)?"),
    ("PRIVATE_KEY", "\\1", r"(?i)(private_?key[\x27\x22]?\s*[:=]\s*[\x27\x22\x60]?)[A-Za-z0-9/+=_-]{8,}"),
    ("AWS_ACCESS_KEY", "", r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    ("AWS_SECRET", "\\1", r"(?i)(aws_?secret(?:_?access)?(?:_?key)?[\x27\x22]?\s*[:=]\s*[\x27\x22\x60]?)[A-Za-z0-9/+=]{20,}"),
    ("JWT", "", r"eyJ[A-Za-z0-9_=-]+\.eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+"),
    ("DATABASE_URL", "", r"(?:postgres|postgresql|mysql|mongodb|mongodb\+srv|redis|amqp|mssql)://[^\s:@/\x27\x22]*:[^\s@/\x27\x22<>]+@[^\s\x27\x22<>\x60]*"),
    ("API_KEY", "\\1", r"(?i)(api_?key[\x27\x22]?\s*[:=]\s*[\x27\x22\x60]?)[A-Za-z0-9_-]{16,}"),
    ("TOKEN", "\\1", r"(?i)(token[\x27\x22]?\s*[:=]\s*[\x27\x22\x60])[A-Za-z0-9_-]{20,}"),
)


def _redact_sql(column: str) -> str:
    out = column
    for name, keep, p in _SECRETS:
        out = f"regexp_replace({out}, '{p}', '{keep}[REDACTED_{name}]', 'g')"
    return out


@query(f"SELECT paste_id, md5({_redact_sql('content')}) AS md5, content <> {_redact_sql('content')} AS changed FROM paste_files WHERE content IS NOT NULL")
def redaction(s: SparkSession, d: str) -> DataFrame:
    r = tx.redacted("content")
    return _t(s, d, "paste_files").where("content is not null").select("paste_id", F.md5(r).alias("md5"), (F.col("content") != r).alias("changed"))


def _redaction_counts_sql() -> str:
    out, left = [], "content"
    for name, keep, p in _SECRETS:
        out.append(f"SELECT '{name}' AS type, count(*) AS n FROM paste_files WHERE regexp_matches({left}, '{p}')")
        left = f"regexp_replace({left}, '{p}', '{keep}[REDACTED_{name}]', 'g')"
    return "SELECT * FROM (" + " UNION ALL ".join(out) + ") WHERE n > 0"


@query(_redaction_counts_sql())
def redaction_counts(s: SparkSession, d: str) -> DataFrame:
    p = _t(s, d, "paste_files").select(F.explode(tx.redaction_types("content")).alias("type"))
    return p.groupBy("type").agg(F.count("*").alias("n"))


# --- Graph ----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_DEGREES} SELECT repo, node, in_degree, out_degree, CASE WHEN in_degree = 0 AND out_degree = 0 THEN 'isolated' WHEN in_degree = 0 THEN 'root'
    WHEN out_degree = 0 THEN 'leaf' ELSE 'inner' END AS role FROM deg"""
)
def node_degrees(s: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_nodes(s, d), _internal(s, d))


@query(f"WITH {_DEGREES}, {_FANS} SELECT 'in' AS side, * FROM fi UNION ALL SELECT 'out', * FROM fo")
def fan_top10(s: SparkSession, d: str) -> DataFrame:
    g = graph.degrees(_nodes(s, d), _internal(s, d))
    return graph.top_fan(g, "in_degree").select(F.lit("in").alias("side"), "*").unionByName(graph.top_fan(g, "out_degree").select(F.lit("out").alias("side"), "*"))


@query(f"WITH {_DEGREES}, {_FANS} SELECT 'orchestrator' AS role, repo, node, n FROM fo WHERE n >= 10 UNION ALL SELECT 'kernel', repo, node, n FROM fi WHERE n >= 10")
def roles(s: SparkSession, d: str) -> DataFrame:
    g = graph.degrees(_nodes(s, d), _internal(s, d))
    pick = lambda by, name: graph.top_fan(g, by).where("n >= 10").select(F.lit(name).alias("role"), "repo", "node", "n")
    return pick("out_degree", "orchestrator").unionByName(pick("in_degree", "kernel"))


@query(
    f"""WITH {_GRAPH}, x AS (SELECT * FROM a WHERE dst IS NULL OR (repo, dst) NOT IN (SELECT repo, node FROM n))
    SELECT * FROM (SELECT {_PACKAGE} AS package, count(*) AS n FROM x GROUP BY 1) WHERE package <> '' ORDER BY n DESC, package LIMIT 20"""
)
def external_top20(s: SparkSession, d: str) -> DataFrame:
    x = graph.external_edges(_edges(s, d), _nodes(s, d))
    return graph.external_packages(x).orderBy(F.desc("n"), "package").limit(20)


@query(
    f"""WITH {_GRAPH}, x AS (SELECT DISTINCT repo, {_PACKAGE} AS package, specifier FROM a WHERE dst IS NULL OR (repo, dst) NOT IN (SELECT repo, node FROM n))
    SELECT repo, package, array_to_string(list_sort(list(specifier)), ',') AS specifiers FROM x WHERE package <> '' GROUP BY ALL"""
)
def external_deps(s: SparkSession, d: str) -> DataFrame:
    x = graph.package_specifiers(graph.external_edges(_edges(s, d), _nodes(s, d)))
    return x.select("repo", "package", F.array_join("specifiers", ",").alias("specifiers"))


@query(
    f"""WITH {_GRAPH}, nn AS (SELECT repo, count(*) AS n_nodes, greatest(1, count(DISTINCT nullif(regexp_extract(node, '^(packages/[^/]+)/', 1), ''))) AS n_packages FROM n GROUP BY repo), ee AS (SELECT repo, count(*) AS n_edges FROM (SELECT DISTINCT repo, src, dst FROM a WHERE dst IS NOT NULL) GROUP BY repo),
    ii AS (SELECT repo, count(*) AS n_internal FROM e GROUP BY repo)
    SELECT repo, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_packages, 1) AS n_packages, coalesce(n_edges, 0) AS n_edges, coalesce(n_internal, 0) AS n_internal, coalesce(n_edges, 0) - coalesce(n_internal, 0) AS n_external
    FROM nn FULL JOIN ee USING (repo) LEFT JOIN ii USING (repo)"""
)
def graph_totals(s: SparkSession, d: str) -> DataFrame:
    inside = F.regexp_extract("node", "^(packages/[^/]+)/", 1)
    return graph.totals(_nodes(s, d).withColumn("package", F.when(inside != "", inside)), _edges(s, d), _internal(s, d))


@query(
    f"""WITH {_GRAPH}, x AS (SELECT DISTINCT repo, src, {_PACKAGE} AS package FROM a WHERE dst IS NULL OR (repo, dst) NOT IN (SELECT repo, node FROM n))
    SELECT package, count(*) AS n_files, count(DISTINCT repo) AS n_repos FROM x WHERE package <> '' GROUP BY package"""
)
def external_reach(s: SparkSession, d: str) -> DataFrame:
    return graph.external_reach(graph.external_edges(_edges(s, d), _nodes(s, d)))


_OFFERED = """pj AS (SELECT repo, min(path) FILTER (WHERE regexp_matches(path, '^src/.*\\.ts$') AND NOT regexp_matches(path, '\\.[a-z]+\\.ts$')) AS cmd, max(path) FILTER (WHERE path LIKE '%.js') AS main FROM file_infos GROUP BY repo),
ep AS (SELECT repo, cmd AS node FROM pj WHERE cmd IS NOT NULL UNION SELECT repo, main FROM pj WHERE main IS NOT NULL)"""


def _offers(s: SparkSession, d: str) -> DataFrame:
    """A package.json per repository: its first source as a built command, its last script as main file."""
    f = _t(s, d, "file_infos")
    plain = F.col("path").rlike(r"^src/.*\.ts$") & ~F.col("path").rlike(r"\.[a-z]+\.ts$")
    g = f.groupBy("repo").agg(F.min(F.when(plain, F.col("path"))).alias("cmd"), F.max(F.when(F.col("path").endswith(".js"), F.col("path"))).alias("main"))
    built = F.regexp_replace(F.regexp_replace("cmd", "^src/", "dist/"), r"\.ts$", ".js")
    return g.select("repo", F.to_json(F.struct(F.when(F.col("cmd").isNotNull(), F.create_map(F.lit("run"), built)).alias("bin"), F.concat(F.lit("./"), F.regexp_replace("main", r"\.js$", "")).alias("main"))).alias("text"))


@query(f"WITH {_OFFERED}, l AS (SELECT DISTINCT repo, path FROM file_infos), m AS (SELECT pj.repo, arg_min(l.path, p) AS node FROM pj, (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.d.ts'), (4, '.js')) v(p, s), l WHERE l.repo = pj.repo AND l.path = regexp_replace(pj.main, '\\.js$', '') || s GROUP BY pj.repo) SELECT repo, cmd AS node FROM pj WHERE cmd IS NOT NULL UNION SELECT repo, node FROM m")
def entry_points(s: SparkSession, d: str) -> DataFrame:
    return resolve.entry_points(_offers(s, d), _t(s, d, "file_infos"))


@query(
    f"""WITH RECURSIVE {_GRAPH}, {_OFFERED}, r(repo, node, k) AS (SELECT repo, node, 0::BIGINT FROM ep UNION SELECT r.repo, e.dst, k + 1 FROM r JOIN e ON e.repo = r.repo AND e.src = r.node WHERE k < 12),
    m AS (SELECT repo, node, min(k) AS distance FROM r GROUP BY ALL)
    SELECT repo, node, distance, count(*) OVER (PARTITION BY repo) > 30 AS truncated FROM m QUALIFY row_number() OVER (PARTITION BY repo ORDER BY distance, node) <= 30"""
)
def reachable_from_entries(s: SparkSession, d: str) -> DataFrame:
    return graph.reachability(_internal(s, d), resolve.entry_points(_offers(s, d), _t(s, d, "file_infos")), 30)


@query(f"WITH RECURSIVE {_GRAPH}, {_SCC} SELECT repo, node, component FROM scc")
def scc(s: SparkSession, d: str) -> DataFrame:
    return graph.components(_internal(s, d))


@query(
    f"""WITH RECURSIVE {_GRAPH}, s AS (SELECT repo, min(src) AS node FROM e GROUP BY repo),
    r(repo, node) AS (SELECT * FROM s UNION SELECT r.repo, e.dst FROM r JOIN e ON e.repo = r.repo AND e.src = r.node) SELECT repo, node FROM r"""
)
def reachable(s: SparkSession, d: str) -> DataFrame:
    return graph.bfs(_internal(s, d), _seeds(s, d)).select("repo", "node")


@query(
    f"""WITH RECURSIVE {_GRAPH}, s AS (SELECT repo, min(src) AS node FROM e GROUP BY repo),
    r(repo, node, k) AS (SELECT repo, node, 0::BIGINT FROM s UNION SELECT r.repo, e.dst, k + 1 FROM r JOIN e ON e.repo = r.repo AND e.src = r.node WHERE k < 5)
    SELECT repo, node, min(k) AS distance FROM r GROUP BY ALL"""
)
def bfs_depth(s: SparkSession, d: str) -> DataFrame:
    return graph.bfs(_internal(s, d), _seeds(s, d), 5)


@query(
    f"""WITH RECURSIVE {_GRAPH}, s AS (SELECT repo, min(src) AS node FROM e GROUP BY repo),
    r(repo, node, k) AS (SELECT repo, node, 0::BIGINT FROM s UNION SELECT r.repo, e.dst, k + 1 FROM r JOIN e ON e.repo = r.repo AND e.src = r.node WHERE k < 3),
    m AS (SELECT repo, node, min(k) AS k FROM r GROUP BY ALL) SELECT repo, max(k) AS eccentricity, count(*) AS n_nodes FROM m GROUP BY repo"""
)
def eccentricity(s: SparkSession, d: str) -> DataFrame:
    return scoped.eccentricity(graph.bfs(_internal(s, d), _seeds(s, d), 3))


_HUBS2 = _HUBS.replace(">= 5", ">= 2")  # no file of the tables re-exports five times


@query(f"WITH {_GRAPH}, {_HUBS2} SELECT repo, node, reexports, edges_total, reexports / edges_total AS ratio FROM hubs")
def hubs(s: SparkSession, d: str) -> DataFrame:
    return graph.reexport_hubs(_edges(s, d), 2)


@query(f"WITH {_DEGREES}, {_FANS}, {_HUBS}, {_SPOTS} SELECT repo, node, score, coalesce(array_to_string(reasons, ','), '') AS reasons, rank FROM hot")
def hotspots(s: SparkSession, d: str) -> DataFrame:
    h = graph.hotspots(graph.degrees(_nodes(s, d), _internal(s, d)), graph.reexport_hubs(_edges(s, d)))
    return h.withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""WITH {_DEGREES}, {_HUBS2} SELECT repo, node, 'split-imports' AS cut, 'high' AS impact FROM deg WHERE out_degree > 6
    UNION ALL SELECT repo, node, 'reduce-reexports', 'medium' FROM hubs WHERE reexports / edges_total > 0.2 AND reexports > 1"""
)
def suggested_cuts(s: SparkSession, d: str) -> DataFrame:
    return report.suggested_cuts(graph.degrees(_nodes(s, d), _internal(s, d)), graph.reexport_hubs(_edges(s, d), 2), 6, 0.2, 1)


@query(
    f"""WITH RECURSIVE {_DEGREES}, {_FANS}, {_HUBS}, {_SPOTS}, {_SCC},
    g AS (SELECT repo, max(in_degree) AS max_fan_in, max(out_degree) AS max_fan_out, count(*) AS n_nodes FROM deg GROUP BY repo),
    j AS (SELECT g.*, coalesce((SELECT max(reexports) FROM hubs h WHERE h.repo = g.repo), 0) AS max_reexports, (SELECT count(*) FROM hubs h WHERE h.repo = g.repo) AS n_hubs,
        coalesce((SELECT max(score) FROM hot WHERE hot.repo = g.repo), 0) AS max_hotspot, (SELECT count(DISTINCT component) FROM scc WHERE scc.repo = g.repo) AS n_components FROM g),
    k AS (SELECT *, ((n_components > 0)::INT * 3 + (max_fan_out > 20)::INT * 2 + (max_reexports > 30)::INT * 2 + (max_hotspot > 50)::INT)::BIGINT AS risk_score FROM j)
    SELECT *, CASE WHEN risk_score >= 5 THEN 'high' WHEN risk_score >= 3 THEN 'medium' ELSE 'low' END AS risk_level,
    CASE WHEN n_components = 0 AND max_fan_out <= 15 AND n_hubs <= 20 THEN 'No major structural concerns' ELSE
        concat_ws('; ', CASE WHEN n_components > 0 THEN 'Break import cycles' END, CASE WHEN max_fan_out > 15 THEN 'Split files with a high fan-out' END, CASE WHEN n_hubs > 20 THEN 'Consolidate re-export hubs' END) END AS actions FROM k"""
)
def refactor_report(s: SparkSession, d: str) -> DataFrame:
    i, h = _internal(s, d), graph.reexport_hubs(_edges(s, d))
    g = graph.degrees(_nodes(s, d), i)
    return report.report(g, h, graph.hotspots(g, h), graph.components(i)).withColumn("actions", F.array_join("actions", "; "))


@query("SELECT repo, from_path, to_path, kind, specifier FROM import_edges QUALIFY row_number() OVER (PARTITION BY repo, from_path, to_path, kind ORDER BY edge_id) = 1")
def edge_dedupe(s: SparkSession, d: str) -> DataFrame:
    e = manifest.latest(_t(s, d, "import_edges"), ["repo", "from_path", "to_path", "kind"], [F.col("edge_id")])
    return e.select("repo", "from_path", "to_path", "kind", "specifier")


@query(f"SELECT edge_id, {_PACKAGE} AS package, regexp_matches(specifier, '^(\\./|\\.\\./|/)') AS relative FROM import_edges")
def package_of_specifier(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "import_edges").select("edge_id", paths.package_of("specifier").alias("package"), paths.is_relative("specifier").alias("relative"))


# A specifier that a module would write for the file that an edge leads to: up to the root, then down, without its extension.
_WRITTEN = """written AS (SELECT DISTINCT repo, src, './' || repeat('../', len(string_split(src, '/')) - 1) || regexp_replace(dst, '\\.[a-z]+$', '') || CASE WHEN dst LIKE '%.ts' AND length(src) % 2 = 0 THEN '.js' ELSE '' END AS specifier FROM e)"""


def _written(s: SparkSession, d: str) -> DataFrame:
    up = F.concat(F.lit("./"), F.expr("repeat('../', size(split(src, '/')) - 1)"), F.regexp_replace("dst", r"\.[a-z]+$", ""))
    return _internal(s, d).select("repo", "src", F.concat(up, F.when(F.col("dst").endswith(".ts") & (F.length("src") % 2 == 0), ".js").otherwise("")).alias("specifier")).distinct()


@query(
    f"""WITH {_GRAPH}, {_WRITTEN}, b AS (SELECT *, regexp_replace(specifier, '^(\\./|\\.\\./)+', '') AS base FROM written),
    c AS (SELECT repo, src, specifier, p, base || s AS path FROM b, (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.d.ts'), (4, '.js'), (5, '.jsx'), (6, '.mjs'), (7, '/index.ts'), (8, '/index.tsx'), (9, '/index.js')) v(p, s)
        UNION ALL SELECT repo, src, specifier, 100 + p, regexp_replace(base, '\\.m?js$', '') || s FROM b, (VALUES (0, '.ts'), (1, '.tsx'), (2, '.mts')) v(p, s) WHERE regexp_matches(base, '\\.m?js$'))
    SELECT c.repo, src, specifier, arg_min(c.path, p) AS resolved FROM c JOIN (SELECT DISTINCT repo, path FROM file_infos) f ON f.repo = c.repo AND f.path = c.path GROUP BY ALL"""
)
def resolved_specifiers(s: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(_written(s, d), _t(s, d, "file_infos")).where("resolved is not null").select("repo", "src", "specifier", "resolved")


# --- Paste ----------------------------------------------------------------------------------------------------------

_REASON = f"""CASE WHEN {_EXT} NOT IN ('ts', 'tsx', 'js', 'py', 'md') THEN 'extension' WHEN NOT regexp_matches(path, '/.*/') THEN 'not included'
    WHEN contains(path, '.test.') OR regexp_matches(path, 'tools/.*probe') THEN 'excluded'
    WHEN list_has_any(string_split(path, '/')[1:-2], ['node_modules', 'dist', 'build', 'coverage', '.git']) THEN 'directory' END"""


def _reason():
    return paste.exclude_reason("path", ["ts", "tsx", "js", "py", "md"], ["/*/"], [".test.", "tools/*probe"])


@query(f"SELECT paste_id, {_REASON} AS exclude_reason FROM paste_files")
def paste_filter(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "paste_files").select("paste_id", _reason().alias("exclude_reason"))


def _choose_sql(files: int, loc: int, size: int) -> str:
    """``c`` (paste_id, repo, size, loc, included, exclude_reason): the rules, then first fit in path order, as a recursion over rows."""
    return f"""p AS (SELECT paste_id, repo, path, coalesce(size, 0) AS size, coalesce(loc, 0) AS loc, {_REASON} AS reason FROM paste_files),
    o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, paste_id) AS rn FROM p WHERE reason IS NULL AND size <= {size} AND loc <= {loc}),
    f(repo, rn, paste_id, k, l, b, ok) AS (SELECT repo, 0::BIGINT, NULL::BIGINT, 0, 0::HUGEINT, 0::HUGEINT, false FROM o GROUP BY repo UNION ALL
        SELECT o.repo, o.rn, o.paste_id, f.k + (f.k < {files} AND f.l + o.loc <= {loc} AND f.b + o.size <= {size})::INT,
            f.l + CASE WHEN f.k < {files} AND f.l + o.loc <= {loc} AND f.b + o.size <= {size} THEN o.loc ELSE 0 END,
            f.b + CASE WHEN f.k < {files} AND f.l + o.loc <= {loc} AND f.b + o.size <= {size} THEN o.size ELSE 0 END,
            f.k < {files} AND f.l + o.loc <= {loc} AND f.b + o.size <= {size} FROM f JOIN o ON o.repo = f.repo AND o.rn = f.rn + 1),
    c AS (SELECT p.paste_id, p.repo, p.size, p.loc, coalesce(f.ok, false) AS included, CASE WHEN reason IS NOT NULL THEN reason WHEN NOT coalesce(f.ok, false) THEN 'budget exceeded' END AS exclude_reason FROM p LEFT JOIN f USING (paste_id))"""


@query(f"WITH RECURSIVE {_choose_sql(20, 900, 40_000)} SELECT paste_id, included, exclude_reason FROM c")
def paste_budget(s: SparkSession, d: str) -> DataFrame:
    c = paste.choose(_t(s, d, "paste_files").drop("included", "exclude_reason"), "repo", _reason(), 20, 900, 40_000, ["path", "paste_id"])
    return c.select("paste_id", "included", "exclude_reason")


@query(
    f"""WITH RECURSIVE {_choose_sql(100, 50_000, 2_000_000)} SELECT repo, count(*) AS n_files, count(*) FILTER (WHERE included) AS n_included, count(*) FILTER (WHERE NOT included) AS n_excluded,
    coalesce(sum(size) FILTER (WHERE included), 0)::BIGINT AS total_bytes, coalesce(sum(loc) FILTER (WHERE included), 0)::BIGINT AS total_loc, coalesce(bool_or(exclude_reason = 'budget exceeded'), false) AS truncated FROM c GROUP BY repo"""
)
def paste_totals(s: SparkSession, d: str) -> DataFrame:
    c = paste.choose(_t(s, d, "paste_files").drop("included", "exclude_reason"), "repo", _reason(), order=["path", "paste_id"])
    return paste.totals(c, "repo")


@query(
    f"""WITH RECURSIVE {_choose_sql(100, 50_000, 2_000_000)}, pf AS (SELECT c.*, p.path, coalesce({_redact_sql('p.content')}, '') AS text FROM c JOIN paste_files p USING (paste_id)),
    i AS (SELECT repo, string_agg(path, chr(10) ORDER BY path, loc::VARCHAR, text) AS idx, string_agg('==== FILE: ' || path || ' (LOC ' || loc || ') ====' || chr(10) || text, chr(10) ORDER BY path, loc::VARCHAR, text) AS body,
        count(*) AS k, sum(size) AS bytes FROM pf WHERE included GROUP BY repo),
    x AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, exclude_reason) AS rn FROM pf WHERE NOT included),
    e AS (SELECT repo, count(*) AS k, string_agg(path || ': ' || exclude_reason, chr(10) ORDER BY path || ': ' || exclude_reason) FILTER (WHERE rn <= 20) AS shown FROM x GROUP BY repo),
    t AS (SELECT i.repo, concat_ws(chr(10), '==== SECTION: HEADER ====', 'Pack', '==== INDEX ====', idx, body, '==== SUMMARY ====', i.k || ' files, ' || bytes || ' bytes', coalesce(shown, ''),
        CASE WHEN e.k > 20 THEN 'and ' || (e.k - 20) || ' more' END, '==== END ====') AS text FROM i LEFT JOIN e ON e.repo = i.repo)
    SELECT repo, md5(text) AS md5, length(text)::INT AS n_chars FROM t"""
)
def paste_render(s: SparkSession, d: str) -> DataFrame:
    c = paste.choose(_t(s, d, "paste_files").drop("included", "exclude_reason"), "repo", _reason(), order=["path", "paste_id"])
    return paste.render(c, "repo").select("repo", F.md5("text").alias("md5"), F.length("text").alias("n_chars"))


@query(
    """SELECT paste_id, md5(CASE WHEN len(l) <= 50 THEN content ELSE array_to_string(l[1:30], chr(10)) || chr(10) || chr(10) || '... (content truncated after 30 lines)' END) AS md5
    FROM (SELECT paste_id, path, content, string_split(content, chr(10)) AS l FROM paste_files) WHERE content IS NOT NULL AND regexp_matches(path, '\\.(md|yml|yaml|json|env|py)$')"""
)
def signatures_nonsource(s: SparkSession, d: str) -> DataFrame:
    p = _t(s, d, "paste_files").where(F.col("path").rlike(r"\.(md|yml|yaml|json|env|py)$") & F.col("content").isNotNull())
    return paste.signatures(p, "paste_id", "path", "content").select(F.col("id").alias("paste_id"), F.md5("signatures").alias("md5"))


@query()
def signatures(s: SparkSession, d: str) -> DataFrame:
    return paste.signatures(_t(s, d, "paste_files"), "paste_id", "path", "content").select(F.col("id").alias("paste_id"), F.length("signatures").alias("n_chars"))


# --- Catalogues -----------------------------------------------------------------------------------------------------

_TS = "content IS NOT NULL AND regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs)$')"
_SRC = """content IS NOT NULL AND regexp_matches(path, '(?i)\\.(ts|tsx|js|jsx)$') AND NOT regexp_matches(path, '\\.d\\.ts$') AND NOT regexp_matches('/' || path, '/(node_modules|dist)/') AND contains('/' || path, '/src/')"""


def _ts(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "paste_files").where(F.col("content").isNotNull() & F.col("path").rlike(r"\.(ts|tsx|js|jsx|mjs)$"))


def _src(s: SparkSession, d: str) -> DataFrame:
    return source.export_sources(_t(s, d, "paste_files").where(F.col("content").isNotNull()))


@query(
    f"""WITH t AS (SELECT paste_id, content FROM paste_files WHERE {_SRC}),
    x AS (SELECT paste_id, unnest(regexp_extract_all(content, '(?m)^export\\s+(?:const|let|var|function|class|interface|type|enum)\\s+([a-zA-Z_$][a-zA-Z0-9_$]*)', 1)) AS name FROM t
        UNION ALL SELECT paste_id, regexp_replace(trim(regexp_replace(unnest(string_split(b, ',')), '\\s+', ' ', 'g')), ' as \\w+', '') FROM (SELECT paste_id, unnest(regexp_extract_all(content, '(?m)^export\\s*\\{{\\s*([^}}]+)\\s*\\}}', 1)) AS b FROM t)
        UNION ALL SELECT paste_id, 'default' FROM t WHERE regexp_matches(content, '(?m)^export\\s+default')),
    n AS (SELECT paste_id, array_to_string(list_sort(list_distinct(list(name))), ',') AS names FROM x WHERE regexp_matches(name, '^[a-zA-Z_$][a-zA-Z0-9_$]*$') GROUP BY paste_id)
    SELECT t.paste_id, coalesce(names, '') AS names FROM t LEFT JOIN n USING (paste_id)"""
)
def exports_regex(s: SparkSession, d: str) -> DataFrame:
    return _src(s, d).select("paste_id", F.array_join(cat.export_names("content"), ",").alias("names"))


_CODE = r"regexp_replace(regexp_replace(regexp_replace(content, '/\*.*?\*/', ' ', 'gs'), '''[^''\n]*''|\"[^\"\n]*\"', '''''', 'g'), '//[^\n]*', '', 'g')"
_EXPORTED = r"""x AS (SELECT repo, path, paste_id, unnest(regexp_extract_all(c, '(?m)^[ \t]*export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)', 1)) AS name, 'function' AS kind FROM t
    UNION ALL SELECT repo, path, paste_id, unnest(regexp_extract_all(c, '(?m)^[ \t]*export\s+(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)', 1)), 'class' FROM t
    UNION ALL SELECT repo, path, paste_id, unnest(regexp_extract_all(c, '(?m)^[ \t]*export\s+(?:default\s+)?interface\s+([A-Za-z_$][\w$]*)', 1)), 'interface' FROM t
    UNION ALL SELECT repo, path, paste_id, unnest(regexp_extract_all(c, '(?m)^[ \t]*export\s+type\s+([A-Za-z_$][\w$]*)', 1)), 'type' FROM t
    UNION ALL SELECT repo, path, paste_id, unnest(regexp_extract_all(c, '(?m)^[ \t]*export\s+(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)', 1)), 'enum' FROM t
    UNION ALL SELECT repo, path, paste_id, unnest(regexp_extract_all(c, '(?m)^[ \t]*export\s+(?:const|let|var)\s+([A-Za-z_$][\w$]*)', 1)), 'var' FROM t
    UNION ALL SELECT repo, path, paste_id, regexp_replace(trim(regexp_replace(unnest(string_split(regexp_extract(l, '\{([^}]*)\}', 1), ',')), '\s+', ' ', 'g')), '^type |^.* as ', '', 'g'),
    CASE WHEN regexp_matches(l, '\}\s*from$') THEN 'reexport' ELSE 'var' END FROM (SELECT repo, path, paste_id, unnest(regexp_extract_all(c, '(?m)^[ \t]*(export\s*(?:type\s*)?\{[^}]*\}(?:\s*from\b)?)', 1)) AS l FROM t)
    UNION ALL SELECT repo, path, paste_id, unnest(regexp_extract_all(c, '(?m)^[ \t]*export\s*\*\s*as\s+([A-Za-z_$][\w$]*)', 1)), 'reexport' FROM t
    UNION ALL SELECT repo, path, paste_id, 'default', 'default' FROM t WHERE regexp_matches(c, '(?m)^[ \t]*export\s+default\b'))"""
_EXPORTS = f"WITH t AS (SELECT repo, path, paste_id, {_CODE} AS c FROM paste_files WHERE {_SRC}), {_EXPORTED}, y AS (SELECT DISTINCT repo, path, paste_id, name, kind FROM x WHERE regexp_matches(name, '^[A-Za-z_$][\\w$]*$'))"


def _exported(s: SparkSession, d: str) -> DataFrame:
    return cat.exports(_src(s, d), ["repo", "path", "paste_id"], "content")


@query(f"{_EXPORTS} SELECT * FROM y")
def exports_catalogue(s: SparkSession, d: str) -> DataFrame:
    return _exported(s, d)


@query(
    f"""{_EXPORTS}, k AS (SELECT repo, kind, count(*) AS n FROM y GROUP BY ALL)
    SELECT repo, sum(n)::BIGINT AS n_exports, coalesce(sum(n) FILTER (WHERE kind = 'reexport'), 0)::BIGINT AS n_reexports, coalesce(sum(n) FILTER (WHERE kind = 'default'), 0)::BIGINT AS n_defaults,
    array_to_string(list_sort(list(kind || '=' || n)), ',') AS by_kind FROM k GROUP BY repo"""
)
def exports_summary(s: SparkSession, d: str) -> DataFrame:
    return cat.exports_summary(_exported(s, d), "repo")


@query(f"{_EXPORTS} SELECT name, count(DISTINCT path) AS n FROM y GROUP BY name HAVING count(DISTINCT path) > 1 ORDER BY n DESC, name LIMIT 10")
def repeated_exports(s: SparkSession, d: str) -> DataFrame:
    return cat.repeated_names(_exported(s, d), "path")


_SCHEMAS = """sf AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS fn FROM paste_files WHERE content IS NOT NULL AND regexp_matches(path, '(?i)((schema|zod|yup|contract|validator|validation)[^/]*|types?)\\.ts$')),
sc AS (SELECT path, CASE WHEN contains(fn, 'zod') THEN 'zod' WHEN contains(fn, 'yup') THEN 'yup' WHEN contains(fn, 'contract') THEN 'contract' WHEN contains(fn, 'validat') THEN 'validator' WHEN contains(fn, 'schema') THEN 'schema' ELSE 'other' END AS class FROM sf)"""


@query(
    f"""{_EXPORTS}, {_SCHEMAS}, k AS (SELECT class, count(*) AS n FROM sc GROUP BY class)
    SELECT coalesce((SELECT sum(n) FROM k), 0)::BIGINT AS n_files, (SELECT count(*) FROM y WHERE path IN (SELECT path FROM sc)) AS n_exports, coalesce((SELECT string_agg(class || '=' || n, ',' ORDER BY class || '=' || n) FROM k), '') AS by_class"""
)
def schema_totals(s: SparkSession, d: str) -> DataFrame:
    f = cat.schema_files(_t(s, d, "paste_files").where("content is not null")).select("path", cat.schema_class("path").alias("class"))
    return cat.schema_summary(f, _exported(s, d))


_CLAUSES = r"'\b(?:import|export)\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?(?:\*\s*as\s+[\w$]+|\{[^}]*\})'"
_METRICS = rf"""t AS (SELECT paste_id, repo, {_CODE} AS c FROM paste_files WHERE {_TS}), p AS (SELECT *, regexp_replace(c, {_CLAUSES}, ' ', 'g') AS d FROM t),
m AS (SELECT paste_id, repo, len(regexp_extract_all(c, '\bany\b'))::BIGINT AS "any", len(regexp_extract_all(c, '\bunknown\b'))::BIGINT AS unknown, len(regexp_extract_all(c, '\bnever\b'))::BIGINT AS never, len(regexp_extract_all(c, '\bsatisfies\b'))::BIGINT AS satisfies,
    len(regexp_extract_all(d, '\bas\s+const\b'))::BIGINT AS as_const, len(regexp_extract_all(d, '\bas\s+[A-Za-z_$''(\{{\[]|[=(,]\s*<[A-Za-z_$][\w$.]*(?:\[\])?>\s*[\w$''\{{\[]'))::BIGINT AS assertions,
    len(regexp_extract_all(c, '[\w\])?]\s*:\s*[A-Za-z\{{\[(]'))::BIGINT AS annotations, len(regexp_extract_all(c, '[A-Za-z_$][\w$]*|\d+|[^\s\w]'))::BIGINT AS tokens FROM p)"""


@query(f"WITH {_METRICS} SELECT * EXCLUDE (repo) FROM m")
def type_metrics(s: SparkSession, d: str) -> DataFrame:
    return cat.type_metrics(_ts(s, d), ["paste_id"], "content")


@query(
    f"""WITH {_METRICS} SELECT repo, count(*) AS n_files, sum("any")::BIGINT AS "any", sum(unknown)::BIGINT AS unknown, sum(never)::BIGINT AS never, sum(satisfies)::BIGINT AS satisfies, sum(as_const)::BIGINT AS as_const, sum(assertions)::BIGINT AS assertions,
    sum(annotations)::BIGINT AS annotations, sum(tokens)::BIGINT AS tokens, CASE WHEN sum(tokens) > 0 THEN sum("any") / sum(tokens) ELSE 0 END AS any_ratio, CASE WHEN sum(tokens) > 0 THEN sum(annotations) / sum(tokens) ELSE 0 END AS annotated_ratio FROM m GROUP BY repo"""
)
def type_ratios(s: SparkSession, d: str) -> DataFrame:
    return cat.type_ratios(cat.type_metrics(_ts(s, d), ["paste_id", "repo"], "content"), "repo")


@query("SELECT kind, bucket, count(*) AS n_files, sum(bytes)::BIGINT AS bytes, sum(loc)::BIGINT AS loc FROM (SELECT coalesce(kind, '(none)') AS kind, coalesce(bucket, '(none)') AS bucket, bytes, loc FROM file_infos) GROUP BY ROLLUP (kind, bucket)")
def rollup_metrics(s: SparkSession, d: str) -> DataFrame:
    f = _t(s, d, "file_infos").select(F.coalesce("kind", F.lit("(none)")).alias("kind"), F.coalesce("bucket", F.lit("(none)")).alias("bucket"), "bytes", "loc")
    return cat.rollup_metrics(f, ["kind", "bucket"], ["bytes", "loc"])


@query("SELECT coalesce(lockfile, '(none)') AS value, count(*) AS n FROM repos GROUP BY 1")
def config_distribution(s: SparkSession, d: str) -> DataFrame:
    return cat.distribution(_t(s, d, "repos"), "lockfile")


@query(
    """WITH f AS (SELECT file_id, path, lower(regexp_extract(path, '([^/]*)$', 1)) AS n FROM file_infos
        WHERE regexp_matches(path, '(?i)((schema|zod|yup|contract|validator|validation)[^/]*|types?)\\.ts$')),
    c AS (SELECT file_id, CASE WHEN contains(n, 'zod') THEN 'zod' WHEN contains(n, 'yup') THEN 'yup' WHEN contains(n, 'contract') THEN 'contract' WHEN contains(n, 'validat') THEN 'validator' WHEN contains(n, 'schema') THEN 'schema' ELSE 'other' END AS class FROM f)
    SELECT file_id, class, CASE WHEN class IN ('zod', 'yup') THEN class ELSE 'custom' END AS framework FROM c"""
)
def schema_index(s: SparkSession, d: str) -> DataFrame:
    f = cat.schema_files(_t(s, d, "file_infos")).select("file_id", cat.schema_class("path").alias("class"))
    return f.withColumn("framework", cat.schema_framework(F.col("class")))


@query(
    f"""WITH d AS (SELECT DISTINCT repo, from_path AS package, {_PACKAGE} AS dependency FROM import_edges), w AS (SELECT DISTINCT repo, split_part(unnest(packages), '/', -1) AS name FROM repos WHERE packages IS NOT NULL)
    SELECT d.repo, package, coalesce(array_to_string(list_sort(list(dependency) FILTER (WHERE name IS NOT NULL)), ','), '') AS internal,
    coalesce(array_to_string(list_sort(list(dependency) FILTER (WHERE name IS NULL)), ','), '') AS external FROM d LEFT JOIN w ON w.repo = d.repo AND w.name = dependency WHERE dependency <> '' GROUP BY ALL"""
)
def topology(s: SparkSession, d: str) -> DataFrame:
    deps = _t(s, d, "import_edges").select("repo", F.col("from_path").alias("package"), paths.package_of("specifier").alias("dependency")).where("dependency <> ''")
    packages = _t(s, d, "repos").select("repo", F.explode("packages").alias("p")).select("repo", paths.file_name("p").alias("name"))
    w = resolve.workspace_dependencies(deps, packages)
    return w.select("repo", "package", F.array_join("internal", ",").alias("internal"), F.array_join("external", ",").alias("external"))


_NOCOM = r"regexp_replace(regexp_replace(content, '/\*.*?\*/', ' ', 'gs'), '(?m)(^|[^:''\"`\w])//[^\r\n]*', '\1', 'g')"


@query(
    f"""WITH t AS (SELECT paste_id, {_NOCOM} AS c FROM paste_files WHERE {_TS}),
    x AS (SELECT paste_id, 'import' AS kind, unnest(regexp_extract_all(c, '(?m)^[ \\t]*(import\\s+(?:type\\s+)?(?:[\\w$*{{}},\\s]+?\\s+from\\s+)?[\\x27\\x22][^\\x27\\x22\\n]+[\\x27\\x22])', 1)) AS s FROM t
        UNION ALL SELECT paste_id, 'reexport', unnest(regexp_extract_all(c, '(?m)^[ \\t]*(export\\s+(?:type\\s+)?\\{{[^}}]*\\}}\\s*from\\s*[\\x27\\x22][^\\x27\\x22\\n]+[\\x27\\x22])', 1)) FROM t
        UNION ALL SELECT paste_id, 'export', unnest(regexp_extract_all(c, '(?m)^[ \\t]*(export\\s*\\*\\s*(?:as\\s+[A-Za-z_$][\\w$]*\\s+)?from\\s*[\\x27\\x22][^\\x27\\x22\\n]+[\\x27\\x22])', 1)) FROM t)
    SELECT paste_id, kind, regexp_extract(s, '[''\"]([^''\"]+)[''\"]$', 1) AS specifier FROM x"""
)
def imports_extracted(s: SparkSession, d: str) -> DataFrame:
    return frontend.imports(_ts(s, d), ["paste_id"]).select("paste_id", "kind", "specifier")


@query(
    f"""WITH l AS (SELECT paste_id, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM paste_files WHERE {_TS})
    SELECT paste_id, regexp_extract(l, '^(?:export\\s+)?(?:(?:default|async|abstract|declare)\\s+)*(function|class|interface|type|enum|const|let)\\s+([A-Za-z_$][\\w$]*)', 2) AS symbol, regexp_extract(l, '^(?:export\\s+)?(?:(?:default|async|abstract|declare)\\s+)*(function|class|interface|type|enum|const|let)\\s+([A-Za-z_$][\\w$]*)', 1) AS kind, i::BIGINT AS line, regexp_matches(l, '^export\\b') AS exported
    FROM l WHERE regexp_matches(l, '^(?:export\\s+)?(?:(?:default|async|abstract|declare)\\s+)*(function|class|interface|type|enum|const|let)\\s+([A-Za-z_$][\\w$]*)')"""
)
def declarations(s: SparkSession, d: str) -> DataFrame:
    return frontend.declarations(_ts(s, d), ["paste_id"])


_NAMES_OF = r"list_filter(list_transform(flatten(list_transform(regexp_extract_all(t, '\b{0}\s+([A-Za-z_$][\w$]*(?:<[^<>]*>)?(?:\s*,\s*[A-Za-z_$][\w$]*(?:<[^<>]*>)?)*)', 1), lambda x: string_split(regexp_replace(x, '<[^<>]*>', '', 'g'), ','))), lambda x: trim(x)), lambda x: regexp_matches(x, '^[A-Za-z_$][\w$]*$'))"


@query(
    rf"""WITH f AS (SELECT paste_id, regexp_replace({_NOCOM}, '''[^''\n]*''|"[^"\n]*"', '''''', 'g') AS t FROM paste_files WHERE {_TS}),
    x AS (SELECT paste_id, 'extends' AS kind, unnest({_NAMES_OF.format('extends')}) AS name FROM f UNION ALL SELECT paste_id, 'implements', unnest({_NAMES_OF.format('implements')}) FROM f
        UNION ALL SELECT paste_id, 'typeRef', unnest(regexp_extract_all(t, '[)\w?]\s*:\s*(?:Promise<)?([A-Z][\w$]*)', 1)) FROM f UNION ALL SELECT paste_id, 'calls', unnest(regexp_extract_all(t, '(?:^|[^.\w$])([A-Za-z_$][\w$]*)\s*\(', 1)) FROM f)
    SELECT paste_id, kind, name, count(*) AS n FROM x WHERE kind <> 'calls' OR name NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'function', 'typeof', 'await', 'new', 'super', 'import', 'constructor', 'throw') GROUP BY ALL"""
)
def typed_edges(s: SparkSession, d: str) -> DataFrame:
    return frontend.typed_edges(_ts(s, d), ["paste_id"])


@query(
    r"""WITH t AS (SELECT slice_id, unnest(regexp_extract_all(doc, '(?m)^[ \t]*(?:/?\*+)?[ \t]*(@[A-Za-z]+[^\r\n]*)', 1)) AS t FROM code_slices WHERE doc IS NOT NULL)
    SELECT slice_id, regexp_extract(t, '^@([A-Za-z]+)', 1) AS tag, trim(regexp_replace(regexp_replace(t, '^@[A-Za-z]+', ''), '\*/\s*$', '')) AS text FROM t"""
)
def doc_tags(s: SparkSession, d: str) -> DataFrame:
    return frontend.doc_tags(_t(s, d, "code_slices"), ["slice_id"])


# --- Scoped ---------------------------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT repo, path, start_line AS s, greatest(start_line, end_line) AS e,
        max(greatest(start_line, end_line)) OVER (PARTITION BY repo, path ORDER BY start_line, greatest(start_line, end_line) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM code_slices WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
    v AS (SELECT *, CASE WHEN r IS NULL OR s - r > 2 THEN 1 ELSE 0 END AS new FROM w),
    g AS (SELECT *, sum(new) OVER (PARTITION BY repo, path ORDER BY s, e, new DESC ROWS UNBOUNDED PRECEDING) AS g FROM v)
    SELECT repo, path, min(s) AS start_line, max(e) AS end_line, count(*) AS n FROM g GROUP BY repo, path, g"""
)
def slice_merge(s: SparkSession, d: str) -> DataFrame:
    return scoped.merge_ranges(_t(s, d, "code_slices"), ["repo", "path"], "start_line", "end_line")


@query(
    """WITH l AS (SELECT slice_id, regexp_escape(symbol_name) AS n, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM code_slices)
    SELECT c.slice_id, min(l.i)::BIGINT AS line FROM code_slices c LEFT JOIN l ON l.slice_id = c.slice_id AND regexp_matches(trim(regexp_replace(l.l, '[\\r\\t]', ' ', 'g')),
    '^(?:export\\s+)?(?:(?:default|async|abstract|declare)\\s+)*(?:function|class|interface|type|enum|const|let)\\s+' || n || '(?:[^\\w$]|$)|^' || n || '\\s*[:=]') GROUP BY c.slice_id"""
)
def line_search(s: SparkSession, d: str) -> DataFrame:
    return scoped.find_declaration(_t(s, d, "code_slices"), "slice_id", "body", "symbol_name").select(F.col("id").alias("slice_id"), "line")


@query(
    """SELECT slice_id, floor(b * CASE WHEN k = 0 THEN 1.5 ELSE greatest(0.5, 1 - 0.1 * k) END + 0.5)::BIGINT AS tokens, round(2.5 * pow(0.8, k), 6) AS score,
    CASE WHEN regexp_matches(n, '^I[A-Z]') THEN 'interface' WHEN regexp_matches(n, '^[A-Z][A-Z0-9_]+$') THEN 'const' WHEN regexp_matches(n, '^[A-Z]') THEN 'class' ELSE 'function' END AS kind
    FROM (SELECT slice_id, symbol_name AS n, slice_id % 4 AS k, CASE WHEN regexp_matches(symbol_name, '^I[A-Z0-9_]') THEN 50 WHEN regexp_matches(symbol_name, '^[A-Z0-9_]') THEN 200
        WHEN regexp_matches(symbol_name, 'create|build|generate') THEN 150 ELSE 100 END AS b FROM code_slices WHERE symbol_name IS NOT NULL)"""
)
def symbol_estimates(s: SparkSession, d: str) -> DataFrame:
    c = _t(s, d, "code_slices").where("symbol_name is not null")
    k = F.col("slice_id") % 4
    return c.select("slice_id", symbols.token_estimate("symbol_name", k).alias("tokens"), F.round(symbols.edge_score(symbols.edge_weight(F.lit("typeRef")), k), 6).alias("score"), symbols.guessed_kind("symbol_name").alias("kind"))


_SEEDS = """s AS (SELECT slice_id, symbol_id AS seed FROM code_slices WHERE symbol_id IS NOT NULL UNION ALL SELECT slice_id, symbol_id || '.go' FROM code_slices WHERE symbol_id IS NOT NULL
    UNION ALL SELECT slice_id, symbol_id || '(<' || slice_id || '>)' FROM code_slices WHERE symbol_id IS NOT NULL
    UNION ALL SELECT slice_id, path || '#line:' || start_line || ':7' FROM code_slices WHERE start_line IS NOT NULL UNION ALL SELECT slice_id, path || ':' || start_line FROM code_slices WHERE start_line IS NOT NULL UNION ALL SELECT slice_id, path FROM code_slices)"""


@query(
    rf"""WITH {_SEEDS}, p AS (SELECT *, regexp_matches(seed, '^[^#:]+#[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)?$') AS named, regexp_matches(seed, '^[^#:]+(#line)?:\d{{1,9}}(:\d{{1,9}})?$') AS lined, regexp_matches(seed, '^[^#:]+#[A-Za-z_$][\w$]*\(<[^>]+>\)$') AS loaded FROM s)
    SELECT slice_id, seed, coalesce(named OR lined OR loaded, false) AS valid, CASE WHEN named OR lined OR loaded THEN regexp_extract(seed, '^([^#:]+)', 1) END AS path, CASE WHEN named OR loaded THEN regexp_extract(seed, '#([A-Za-z_$][\w$]*)', 1) END AS symbol,
    CASE WHEN loaded THEN regexp_extract(seed, '<([^>]+)>', 1) END AS overload,
    CASE WHEN named THEN nullif(regexp_extract(seed, '#[A-Za-z_$][\w$]*\.(.+)$', 1), '') END AS member, CASE WHEN lined THEN regexp_extract(seed, '^[^#:]+(?:#line)?:(\d+)', 1)::BIGINT END AS line,
    CASE WHEN lined THEN nullif(regexp_extract(seed, '^[^#:]+(?:#line)?:\d+:(\d+)$', 1), '')::BIGINT END AS col FROM p"""
)
def seed_parse(s: SparkSession, d: str) -> DataFrame:
    c = _t(s, d, "code_slices")
    at = F.col("start_line").cast("string")
    forms = [F.col("symbol_id"), F.concat("symbol_id", F.lit(".go")), F.concat("symbol_id", F.lit("(<"), F.col("slice_id").cast("string"), F.lit(">)")), F.concat("path", F.lit("#line:"), at, F.lit(":7")), F.concat("path", F.lit(":"), at), F.col("path")]
    p = c.select("slice_id", F.explode(F.array(*forms)).alias("seed")).where("seed is not null").withColumn("s", symbols.parse_seed("seed"))
    return p.select("slice_id", "seed", "s.valid", "s.path", "s.symbol", "s.member", "s.line", "s.col", "s.overload")


@query(
    r"""WITH n AS (SELECT DISTINCT symbol_name || s AS n FROM code_slices, (VALUES (''), ('Type'), ('_Config'), ('_Enum'), ('_items')) v(s) WHERE symbol_name IS NOT NULL),
    f AS (SELECT *, regexp_matches(n, '^I([^a-z]|$)') AS i, regexp_matches(n, '^[^a-z]') AND NOT contains(n, '_') AS c, regexp_matches(n, '^[^a-z]') AS u FROM n)
    SELECT n AS name, CASE WHEN i THEN 'interface' WHEN c THEN 'class' WHEN regexp_matches(n, '(Type|Config)$') THEN 'type' WHEN u AND regexp_matches(n, 'Enum$') THEN 'enum' ELSE 'function' END AS graph,
    CASE WHEN c THEN 'class' WHEN i THEN 'interface' ELSE 'function' END AS slice,
    CASE WHEN i THEN 'interface' WHEN c THEN 'class' WHEN regexp_matches(n, '(Type|Config|Options)$') THEN 'type' WHEN u AND regexp_matches(n, '(s|Enum)$') THEN 'enum' WHEN regexp_matches(n, '^[^A-Z]') THEN 'function' ELSE 'const' END AS stub FROM f"""
)
def symbol_kinds(s: SparkSession, d: str) -> DataFrame:
    suffix = F.explode(F.array(*map(F.lit, ("", "Type", "_Config", "_Enum", "_items")))).alias("s")
    n = _t(s, d, "code_slices").where("symbol_name is not null").select("symbol_name", suffix).select(F.concat("symbol_name", "s").alias("name")).distinct()
    return n.select("name", *[symbols.inferred_kind("name", v).alias(v) for v in ("graph", "slice", "stub")])


@query("SELECT symbol_id, count(*) AS n_slices, sum(tokens.average)::BIGINT AS tokens FROM code_slices WHERE symbol_id IS NOT NULL GROUP BY symbol_id")
def token_by_symbol(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "code_slices").where("symbol_id is not null").groupBy("symbol_id").agg(F.count("*").alias("n_slices"), F.sum("tokens.average").cast("bigint").alias("tokens"))


@query(
    r"""WITH n AS (SELECT repo, path, arg_max(len(regexp_extract_all(content, '\r\n|\r|\n')) + 1, paste_id) AS total FROM paste_files WHERE content IS NOT NULL AND content <> '' GROUP BY ALL)
    SELECT slice_id, greatest(1, start_line - 3) AS from_line, least(total, end_line + 3)::BIGINT AS to_line,
    (SELECT coalesce(sum(length(x) + 1), 0) FROM (SELECT unnest(string_split(body, chr(10))[1:2]) AS x))::BIGINT AS third_line_at FROM code_slices LEFT JOIN n USING (repo, path) WHERE body IS NOT NULL AND len(string_split(body, chr(10))) >= 3"""
)
def context_lines(s: SparkSession, d: str) -> DataFrame:
    c = _t(s, d, "code_slices").where("body is not null").where(F.size(F.split("body", "\n")) >= 3)
    # The lines of a file's latest record; a slice without one is not clamped.
    n = (F.regexp_count("content", F.lit(r"\r\n|\r|\n")) + 1).cast("bigint")
    f = _t(s, d, "paste_files").where("content is not null and content <> ''").groupBy("repo", "path").agg(F.max_by(n, "paste_id").alias("total"))
    c = c.join(f, ["repo", "path"], "left")
    return c.select("slice_id", symbols.context_range("start_line", "end_line", "total").alias("r"), symbols.char_offset("body", F.lit(3)).alias("third_line_at")).select("slice_id", "r.from_line", "r.to_line", "third_line_at")


# Modules: the latest paste record of a path with a text. The tables' texts name nothing that they declare, so each module
# gets code that does: imports of the files that its import edges lead to, calls of what these declare, and functions and
# a class that use its own declarations. Symbols reach from their declaration to the next one.
_TOP_SQL = r"'^(?:export\s+)?(?:(?:default|async|abstract|declare)\s+)*(function|class|interface|type|enum|const|let)\s+([A-Za-z_$][\w$]*)'"
_MODULES = rf"""lf0 AS (SELECT repo, path, replace(content, chr(13) || chr(10), chr(10)) AS content FROM paste_files WHERE content IS NOT NULL AND content <> '' AND regexp_matches(path, '\.(ts|tsx|js|jsx|mjs)$') QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY paste_id DESC) = 1),
lf1 AS (SELECT *, regexp_extract_all(content, '(?m)' || {_TOP_SQL}, 2) AS names FROM lf0),
im0 AS (SELECT DISTINCT a.repo, a.from_path AS src, a.to_path AS dst FROM import_edges a JOIN lf1 x ON x.repo = a.repo AND x.path = a.from_path JOIN lf1 y ON y.repo = a.repo AND y.path = a.to_path WHERE len(y.names) > 0 AND a.from_path <> a.to_path),
im AS (SELECT im0.*, y.names[1] AS first, row_number() OVER (PARTITION BY im0.repo, src ORDER BY dst) AS k, './' || repeat('../', len(string_split(src, '/')) - 1) || regexp_replace(dst, '\.[a-z]+$', '') || CASE WHEN dst LIKE '%.ts' AND length(src) % 2 = 0 THEN '.js' ELSE '' END AS specifier
    FROM im0 JOIN lf1 y ON y.repo = im0.repo AND y.path = im0.dst),
ims AS (SELECT repo, src AS path, string_agg('import {{ ' || first || ' as other' || k || ' }} from ''' || specifier || ''';' || chr(10), '' ORDER BY k) AS head,
    string_agg(chr(10) || 'export function reach' || k || '() {{' || chr(10) || '  other' || k || '();' || chr(10) || '}}', '' ORDER BY k) AS tail FROM im GROUP BY ALL),
lf AS (SELECT l.repo, l.path, coalesce(head, '') || content || CASE WHEN len(names) < 2 THEN '' ELSE list_aggregate(list_transform(range(1, len(names)), lambda i: chr(10) || 'export function linked' || i || '(): ' || names[i] || ' {{' || chr(10) || '  return ' || names[i] || '(' || names[i + 1] || '());' || chr(10) || '}}'), 'string_agg', '')
    || chr(10) || 'class Linked extends ' || names[1] || ' implements ' || names[2] || ', ' || names[1] || ' {{ }}' END || coalesce(tail, '') AS content FROM lf1 l LEFT JOIN ims i ON i.repo = l.repo AND i.path = l.path),
ll AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM lf),
ld AS (SELECT *, regexp_matches(l, {_TOP_SQL}) AS d FROM ll),
lg AS (SELECT *, sum(d::INT) OVER (PARTITION BY repo, path ORDER BY i) AS g FROM ld),
sy AS (SELECT repo, path, g, arg_min(regexp_extract(l, {_TOP_SQL}, 2), i) AS symbol, arg_min(regexp_extract(l, {_TOP_SQL}, 1), i) AS kind, min(i)::BIGINT AS line, max(i)::BIGINT AS end_line, arg_min(starts_with(l, 'export'), i) AS exported,
    string_agg(CASE WHEN d THEN regexp_replace(l, {_TOP_SQL}, '') ELSE l END, chr(10) ORDER BY i) FILTER (WHERE d OR NOT regexp_matches(l, '^\s*(//|\*|/\*)')) AS code FROM lg WHERE g > 0 GROUP BY ALL)"""
_REFS = r"""rc AS (SELECT repo, path, symbol, kind, regexp_replace(code, '''[^''\n]*''|"[^"\n]*"', '''''', 'g') AS c FROM sy),
rh AS (SELECT *, string_split(c, '{')[1] AS h FROM rc),
rn AS (SELECT DISTINCT repo, path, symbol, 'calls' AS kind, unnest(regexp_extract_all(c, '(?:^|[^.\w$])([A-Za-z_$][\w$]*)\s*\(', 1)) AS name FROM rh
    UNION SELECT repo, path, symbol, 'typeRef', unnest(regexp_extract_all(regexp_extract(h, '\)\s*:\s*([^={;]+)', 1), '[A-Za-z_$][\w$]*')) FROM rh WHERE kind = 'function'
    UNION SELECT repo, path, symbol, 'extends', regexp_extract(trim(unnest(string_split(regexp_extract(h, '\bextends\s+([^{]+)', 1), ','))), '^[A-Za-z_$][\w$]*') FROM rh WHERE kind IN ('class', 'interface')
    UNION SELECT repo, path, symbol, 'implements', regexp_extract(trim(unnest(string_split(regexp_extract(h, '\bimplements\s+([^{]+)', 1), ','))), '^[A-Za-z_$][\w$]*') FROM rh WHERE kind IN ('class', 'interface')),
refs AS (SELECT * FROM rn WHERE name <> '' AND (kind <> 'typeRef' OR regexp_matches(name, '^[A-Z]')) AND (kind <> 'calls' OR name NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'function', 'typeof', 'await', 'new', 'super', 'import', 'constructor', 'throw')))"""
_SYMBOL_EDGES = r"""cd AS (SELECT repo, src, first, k, p, regexp_replace(specifier, '^(\./|\.\./)+', '') || s AS path FROM im, (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.d.ts'), (4, '.js'), (5, '.jsx'), (6, '.mjs'), (7, '/index.ts'), (8, '/index.tsx'), (9, '/index.js')) v(p, s)
    UNION ALL SELECT repo, src, first, k, 100 + p, regexp_replace(regexp_replace(specifier, '^(\./|\.\./)+', ''), '\.m?js$', '') || s FROM im, (VALUES (0, '.ts'), (1, '.tsx'), (2, '.mts')) v(p, s) WHERE regexp_matches(specifier, '\.m?js$')),
bd AS (SELECT cd.repo, src AS path, 'other' || k AS name, arg_min(cd.path, p) AS to_path, any_value(first) AS to_symbol FROM cd JOIN lf0 ON lf0.repo = cd.repo AND lf0.path = cd.path GROUP BY ALL),
tg AS (SELECT r.*, coalesce(bd.to_path, r.path) AS to_path, coalesce(bd.to_symbol, r.name) AS to_symbol FROM refs r LEFT JOIN bd ON bd.repo = r.repo AND bd.path = r.path AND bd.name = r.name),
se AS (SELECT DISTINCT r.repo, r.path || '#' || r.symbol AS src, r.to_path || '#' || r.to_symbol AS dst, r.kind, CASE r.kind WHEN 'calls' THEN 3.0 WHEN 'typeRef' THEN 2.5 ELSE 2.0 END::DOUBLE AS weight,
    CASE r.kind WHEN 'calls' THEN 'direct-call' WHEN 'typeRef' THEN 'return-type' ELSE r.kind END AS reason FROM tg r JOIN (SELECT DISTINCT repo, path, symbol FROM sy) t ON t.repo = r.repo AND t.path = r.to_path AND t.symbol = r.to_symbol
    WHERE r.path || '#' || r.symbol <> r.to_path || '#' || r.to_symbol)"""
_BOTH_WAYS = "bw AS (SELECT repo, src, dst, reason, kind FROM se UNION SELECT repo, dst, src, 'referenced-by', 'referencedBy' FROM se), seed AS (SELECT repo, min(src) AS node FROM se GROUP BY repo)"
_SYMBOL_GRAPH = """walk(repo, node, k) AS (SELECT repo, node, 0::BIGINT FROM seed UNION SELECT w.repo, bw.dst, k + 1 FROM walk w JOIN bw ON bw.repo = w.repo AND bw.src = w.node WHERE k < 2),
reached AS (SELECT repo, node, min(k) AS distance FROM walk GROUP BY ALL),
near AS (SELECT r.*, row_number() OVER (PARTITION BY repo ORDER BY distance, node) AS rn FROM reached r WHERE (repo, split_part(node, '#', 1)) IN (
    SELECT (repo, f) FROM (SELECT repo, split_part(node, '#', 1) AS f, row_number() OVER (PARTITION BY repo ORDER BY min((distance, node))) AS n FROM reached GROUP BY repo, split_part(node, '#', 1)) WHERE n <= 50) QUALIFY rn <= 1000),
why AS (SELECT bw.repo, bw.dst AS node, bw.reason FROM bw JOIN reached r ON r.repo = bw.repo AND r.node = bw.src UNION SELECT repo, node, 'seed' FROM seed),
sg AS (SELECT n.repo, n.node, n.distance, list_sort(list(DISTINCT why.reason)) AS reasons FROM near n JOIN why ON why.repo = n.repo AND why.node = n.node GROUP BY ALL)"""


def _modules(s: SparkSession, d: str) -> DataFrame:
    p = _ts(s, d).where("content <> ''").select("repo", "path", "paste_id", F.replace("content", F.lit("\r\n"), F.lit("\n")).alias("content"))
    m = manifest.latest(p, ["repo", "path"], [F.desc("paste_id")]).withColumn("names", F.regexp_extract_all("content", F.lit("(?m)" + symbolgraph.TOP), F.lit(2)))
    e = _t(s, d, "import_edges").select("repo", F.col("from_path").alias("src"), F.col("to_path").alias("dst")).distinct().where("src <> dst")
    e = e.join(m.select("repo", F.col("path").alias("src")), ["repo", "src"], "left_semi").join(m.where(F.size("names") > 0).select("repo", F.col("path").alias("dst"), F.col("names")[0].alias("first")), ["repo", "dst"])
    up = F.concat(F.lit("./"), F.expr("repeat('../', size(split(src, '/')) - 1)"), F.regexp_replace("dst", r"\.[a-z]+$", ""), F.when(F.col("dst").endswith(".ts") & (F.length("src") % 2 == 0), ".js").otherwise(""))
    e = e.withColumns({"k": F.row_number().over(Window.partitionBy("repo", "src").orderBy("dst")), "specifier": up})
    k = F.col("k").cast("string")
    head = F.concat(F.lit("import { "), F.col("first"), F.lit(" as other"), k, F.lit(" } from '"), F.col("specifier"), F.lit("';\n"))
    tail = F.concat(F.lit("\nexport function reach"), k, F.lit("() {\n  other"), k, F.lit("();\n}"))
    lines = e.groupBy("repo", F.col("src").alias("path")).agg(F.array_sort(F.collect_list(F.struct("k", head.alias("head"), tail.alias("tail")))).alias("x"))
    joined = lambda field: F.coalesce(F.array_join(F.transform("x", lambda y: y[field]), ""), F.lit(""))
    name = lambda i: F.get("names", i)
    linked = F.transform(
        F.sequence(F.lit(1), F.size("names") - 1),
        lambda i: F.concat(F.lit("\nexport function linked"), i.cast("string"), F.lit("(): "), name(i - 1), F.lit(" {\n  return "), name(i - 1), F.lit("("), name(i), F.lit("());\n}")),
    )
    own = F.when(F.size("names") < 2, "").otherwise(F.concat(F.array_join(linked, ""), F.lit("\nclass Linked extends "), name(F.lit(0)), F.lit(" implements "), name(F.lit(1)), F.lit(", "), name(F.lit(0)), F.lit(" { }")))
    return m.join(lines, ["repo", "path"], "left").select("repo", "path", F.concat(joined("head"), "content", own, joined("tail")).alias("content"))


def _symbols(s: SparkSession, d: str) -> DataFrame:
    return symbolgraph.symbols(_modules(s, d), ["repo", "path"])


def _symbol_edges(s: SparkSession, d: str) -> DataFrame:
    found = cut(_symbols(s, d))
    return cut(symbolgraph.symbol_edges(found, symbolgraph.import_bindings(_modules(s, d))))


def _symbol_seeds(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo").agg(F.min("src").alias("node"))


def _near(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The symbol graph around the first symbol of each repository that refers to one, and all edges."""
    e = _symbol_edges(s, d)
    return cut(symbolgraph.symbol_graph(symbolgraph.both_ways(e), _symbol_seeds(e), 3)), e


@query(f"WITH {_MODULES} SELECT repo, path, symbol, kind, line, end_line, exported FROM sy")
def module_symbols(s: SparkSession, d: str) -> DataFrame:
    return _symbols(s, d).drop("refs")


@query(f"WITH {_MODULES}, {_REFS} SELECT repo, path, symbol, kind, name FROM refs")
def symbol_references(s: SparkSession, d: str) -> DataFrame:
    return _symbols(s, d).select("repo", "path", "symbol", F.explode("refs").alias("r")).select("repo", "path", "symbol", "r.kind", "r.name").distinct()


@query(f"WITH {_MODULES}, {_REFS}, {_SYMBOL_EDGES} SELECT repo, src, dst, kind, weight, reason FROM se")
def symbol_edges(s: SparkSession, d: str) -> DataFrame:
    return _symbol_edges(s, d)


@query(f"WITH {_MODULES}, {_REFS}, {_SYMBOL_EDGES} SELECT DISTINCT repo, dst AS src, src AS dst, 'referencedBy' AS kind, 2.0::DOUBLE AS weight FROM se WHERE (repo, dst) IN (SELECT (repo, min(dst)) FROM se GROUP BY repo)")
def incoming_references(s: SparkSession, d: str) -> DataFrame:
    e = _symbol_edges(s, d)
    return scoped.incoming(e, e.groupBy("repo").agg(F.min("dst").alias("node")))


@query(
    f"""WITH {_MODULES}, n AS (SELECT repo, path, symbol, lead(symbol) OVER (PARTITION BY repo, path ORDER BY line, symbol) AS after FROM sy)
    SELECT repo, path || '#' || symbol AS src, path || '#' || after AS dst, 'sameFileSibling' AS kind FROM n WHERE after IS NOT NULL"""
)
def sibling_symbols(s: SparkSession, d: str) -> DataFrame:
    return scoped.sibling_edges(_symbols(s, d))


@query(f"WITH RECURSIVE {_MODULES}, {_REFS}, {_SYMBOL_EDGES}, {_BOTH_WAYS}, {_SYMBOL_GRAPH} SELECT repo, node, distance, array_to_string(reasons, ',') AS reasons FROM sg")
def symbol_graph(s: SparkSession, d: str) -> DataFrame:
    return _near(s, d)[0].withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""WITH RECURSIVE {_MODULES}, {_REFS}, {_SYMBOL_EDGES}, {_BOTH_WAYS}, {_SYMBOL_GRAPH},
    n AS (SELECT repo, count(*) AS n_edges FROM (SELECT DISTINCT repo, src, dst, kind FROM se) WHERE (repo, src) IN (SELECT (repo, node) FROM sg) AND (repo, dst) IN (SELECT (repo, node) FROM sg) GROUP BY repo)
    SELECT repo, count(*) AS n_nodes, coalesce(any_value(n_edges), 0) AS n_edges, count(DISTINCT split_part(node, '#', 1)) AS n_files, max(distance) AS eccentricity,
    sum(strlen(json_object('distance', distance, 'node', node, 'reasons', reasons)::VARCHAR))::BIGINT AS json_bytes FROM sg LEFT JOIN n USING (repo) GROUP BY repo"""
)
def symbol_graph_stats(s: SparkSession, d: str) -> DataFrame:
    return symbolgraph.graph_stats(*_near(s, d))


@query(
    f"""WITH RECURSIVE {_MODULES}, {_REFS}, {_SYMBOL_EDGES}, {_BOTH_WAYS}, {_SYMBOL_GRAPH}
    SELECT repo, node, CASE WHEN distance = 0 THEN '🌱' WHEN (repo, node) NOT IN (SELECT (repo, src) FROM se) THEN '🍃' ELSE '🔗' END || ' ' || node || ' (' || CASE WHEN regexp_matches(split_part(node, '#', 2), '^I([^a-z]|$)') THEN 'interface'
        WHEN regexp_matches(split_part(node, '#', 2), '^[^a-z]') AND NOT contains(split_part(node, '#', 2), '_') THEN 'class' WHEN regexp_matches(split_part(node, '#', 2), '(Type|Config)$') THEN 'type'
        WHEN regexp_matches(split_part(node, '#', 2), '^[^a-z].*Enum$') THEN 'enum' ELSE 'function' END || ')' AS line FROM sg"""
)
def symbol_marks(s: SparkSession, d: str) -> DataFrame:
    return symbolgraph.marked(*_near(s, d))


def _ranked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g, e = _near(s, d)
    return g, cut(scoped.rank(g.withColumn("name", F.substring_index("node", "#", -1)), e, 600))


@query()
def rank_order(s: SparkSession, d: str) -> DataFrame:
    return _ranked(s, d)[1]


@query()
def rank_totals(s: SparkSession, d: str) -> DataFrame:
    return scoped.rank_stats(_ranked(s, d)[1])


@query()
def scoped_index(s: SparkSession, d: str) -> DataFrame:
    g, r = _ranked(s, d)
    c = _t(s, d, "code_slices").where("symbol_id is not null").select("repo", F.col("symbol_id").alias("node"), "path", "start_line", "end_line", "tokens.conservative", "tokens.optimistic", "tokens.average")
    i = symbolgraph.index(g, r, c)
    return i.select("repo", "node", "distance", "kind", "score", "included", F.size("places").cast("bigint").alias("n_slices"), "average")


@query()
def scoped_stubs(s: SparkSession, d: str) -> DataFrame:
    g, r = _ranked(s, d)
    return scoped.stubs(scoped.left_out(g, r)).select("owner", "n", F.md5("text").alias("md5"), validate.stub_ok("text").alias("ok"))


@query()
def scoped_budget(s: SparkSession, d: str) -> DataFrame:
    e = _symbol_edges(s, d)
    nodes = _symbols(s, d).select("repo", symbols.symbol_id("path", "symbol").alias("node"), F.col("path").alias("file"), ((F.col("end_line") - F.col("line") + 1) * 40).alias("bytes"))
    return symbolgraph.budgeted_graph(symbolgraph.both_ways(e), _symbol_seeds(e), nodes, 3, 20, 4_000)


_AVERAGE = "floor((ceil({0} / 3) + ceil({0} / 5)) / 2 + 0.5)"
_T_IN = _AVERAGE.format("length(s)")


@query(
    f"""WITH p AS (SELECT repo, path, start_line, contains(path, '/api/') AS is_seed, '==== EXCERPT: ' || path || ' L' || start_line || '–L' || coalesce(end_line, start_line) || ' ====' || chr(10)
        || coalesce(regexp_replace(body, '\\r\\n?', chr(10), 'g'), '') AS s FROM code_slices WHERE start_line IS NOT NULL),
    f AS (SELECT repo, path, count(*) AS k, path || ' (' || CASE WHEN bool_or(is_seed) THEN 'seed' ELSE 'file' END || ')' AS line FROM p GROUP BY repo, path),
    t AS (SELECT repo, '==== SECTION: HEADER ====' || chr(10) || 'Files: ' || count(*) || chr(10) || 'Excerpts: ' || sum(k)::BIGINT AS head, '==== INDEX ====' || chr(10) || string_agg(line, chr(10) ORDER BY path, line) AS idx FROM f GROUP BY repo),
    u AS (SELECT *, {_AVERAGE.format('length(head)')} <= 5000 AS kh, CASE WHEN {_AVERAGE.format('length(head)')} <= 5000 THEN {_AVERAGE.format('length(head)')} ELSE 0 END AS u1 FROM t),
    v AS (SELECT *, u1 + {_AVERAGE.format('length(idx)')} <= 5000 AS ki, u1 + CASE WHEN u1 + {_AVERAGE.format('length(idx)')} <= 5000 THEN {_AVERAGE.format('length(idx)')} ELSE 0 END AS used FROM u),
    r AS (SELECT p.*, used, used + sum({_T_IN}) OVER (PARTITION BY repo ORDER BY is_seed DESC, path, start_line, s ROWS UNBOUNDED PRECEDING) AS total FROM p JOIN v USING (repo)),
    g AS (SELECT repo, string_agg(s, chr(10) || chr(10) ORDER BY is_seed DESC, path, start_line, s) FILTER (WHERE total <= 5000) AS body, count(*) FILTER (WHERE total > 5000) AS omitted,
        coalesce(max(total) FILTER (WHERE total <= 5000), max(used))::BIGINT AS tokens FROM r GROUP BY repo),
    z AS (SELECT g.*, head, idx, kh, ki, '==== SUMMARY ====' || chr(10) || 'Total tokens: ' || tokens || chr(10) || 'Truncated: ' || CASE WHEN omitted > 0 THEN 'Yes' ELSE 'No' END AS summary FROM g JOIN v USING (repo))
    SELECT repo, omitted, tokens, md5(concat_ws(chr(10) || chr(10), CASE WHEN kh THEN head END, CASE WHEN ki THEN idx END, body, CASE WHEN tokens + {_AVERAGE.format('length(summary)')} <= 5000 THEN summary END,
        CASE WHEN omitted > 0 THEN '…omitted ' || omitted || ' excerpts due to budget constraints' END, '==== END ====')) AS md5 FROM z"""
)
def scoped_sections(s: SparkSession, d: str) -> DataFrame:
    c = _t(s, d, "code_slices").withColumn("is_seed", F.col("path").contains("/api/")).where("start_line is not null")
    return scoped.scoped_sections(c, 5000).select("repo", "omitted", "tokens", F.md5("text").alias("md5"))


@query()
def scoped_slices(s: SparkSession, d: str) -> DataFrame:
    c = _t(s, d, "code_slices").select("repo", "path", F.col("symbol_name").alias("symbol"), F.col("start_line").alias("line")).distinct()
    p = manifest.latest(_t(s, d, "paste_files").where("content is not null and content <> ''"), ["repo", "path"], [F.desc("paste_id")])
    return scoped.slices(p, c).select("repo", "path", "symbol", "start_line", "end_line", F.md5("body").alias("md5"))


@query(
    """WITH x AS (SELECT DISTINCT path, symbol_name AS n, lower(symbol_kind) AS k FROM code_slices WHERE symbol_name IS NOT NULL),
    y AS (SELECT DISTINCT path, n, CASE k WHEN 'interface' THEN 'export interface ' || n || ' {' || chr(10) || '  [key: string]: unknown;' || chr(10) || '}' WHEN 'class' THEN 'export declare class ' || n || ' {' || chr(10) || '  constructor(...args: unknown[]);' || chr(10) || '}'
        WHEN 'type' THEN 'export type ' || n || ' = unknown;' WHEN 'enum' THEN 'export declare enum ' || n || ' {}' WHEN 'const' THEN 'export declare const ' || n || ': unknown;' ELSE 'export declare function ' || n || '(...args: unknown[]): unknown;' END AS stub FROM x)
    SELECT path AS owner, count(*) AS n, md5('// From ' || path || chr(10) || string_agg(stub, chr(10) || chr(10) ORDER BY n, stub)) AS md5, true AS ok FROM y GROUP BY path"""
)
def symbol_stubs(s: SparkSession, d: str) -> DataFrame:
    c = _t(s, d, "code_slices").select(F.col("path").alias("owner"), F.col("symbol_name").alias("name"), F.lower("symbol_kind").alias("kind"))
    t = scoped.stubs(c)
    return t.select("owner", "n", F.md5("text").alias("md5"), validate.stub_ok("text").alias("ok"))


# --- Root files: the tables hold no configuration texts, so each repository's are written from its row -----------------


def _configured(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "repos").select("repo", F.coalesce("packages", F.array().cast("array<string>")).alias("packages"), "lockfile", F.length("repo").alias("n"))


def _root_files(s: SparkSession, d: str) -> DataFrame:
    """``repo``, ``path``, ``name``, ``text`` of the configuration files at the root and in each package directory."""
    r = _configured(s, d)
    quoted = F.concat(F.lit("["), F.array_join(F.transform("packages", lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ","), F.lit("]"))
    when = lambda cond, text: F.when(F.expr(cond), F.lit(text)).otherwise("")
    package = F.concat(
        F.lit('{"name":"'), F.col("repo"), F.lit('"'), when("n % 2 = 0", ',"type":"module"'), when("n % 3 = 0", ',"devDependencies":{"typescript":"5","@types/node":"22"}'),
        F.when(F.col("lockfile").isin("npm", "yarn"), F.concat(F.lit(',"workspaces":'), F.when(F.expr("n % 2 = 0"), quoted).otherwise(F.concat(F.lit('{"packages":'), quoted, F.lit("}"))))).otherwise(""), F.lit("}"),
    )
    config = F.concat(F.lit('{ // root\n"compilerOptions":{"strict":'), F.expr("if(n % 2 = 0, 'true', 'false')"), F.lit(',"target":"'), F.expr("case n % 3 when 0 then 'es2022' when 1 then '9' else 'ESNext' end"), F.lit('","module":"'), F.expr("if(n % 5 = 0, 'esnext', 'commonjs')"), F.lit('","declaration":true,},\n}'))
    pnpm = F.concat(F.lit("packages:\n"), F.array_join(F.transform("packages", lambda p: F.concat(F.lit("  - '"), p, F.lit("' # one\n"))), ""))
    file = lambda path, text, cond=None: F.when(F.expr(cond) if cond else F.lit(True), F.struct(F.lit(path).alias("path"), (text if isinstance(text, Column) else F.lit(text)).alias("text")))
    root = F.array(
        file("package.json", package), file("tsconfig.json", config, "n % 7 <> 0"), file("jsconfig.json", config, "n % 2 = 0"), file("pnpm-workspace.yaml", pnpm, "lockfile = 'pnpm'"), file("pnpm-lock.yaml", "", "lockfile = 'pnpm'"), file("yarn.lock", "", "lockfile = 'yarn'"),
        file("package-lock.json", "", "lockfile = 'npm' or n % 4 = 0"), file("pyproject.toml", "", "n % 4 = 1"), file("setup.py", "", "n % 8 = 1"), file("turbo.json", "{}", "n % 3 = 1"), file("go.work", "", "n % 9 = 0"),
    )
    first = F.concat(F.col("repo"), F.lit("/"), F.substring_index(F.get("packages", F.lit(0)), "/", -1))
    own = F.concat(F.col("repo"), F.lit("/"), F.substring_index("p", "/", -1))
    inside = r.select("repo", "packages", F.posexplode("packages").alias("i", "p"))
    text = F.concat(F.lit('{"name":"'), own, F.lit('","private":true,"main":"i.js","dependencies":{"left-pad":"1","'), first, F.lit('":"2"},"devDependencies":{"left-pad":"1"},"bin":{"run":"./x.js"},"exports":{".":"./i.js","./b":"./b.js"}}'))
    cfg = F.concat(F.lit('{"compilerOptions":{"strict":true,"target":"es5","module":"'), F.expr("if(i % 2 = 0, 'ES2022', 'node16')"), F.lit('"}}'))
    packed = inside.select("repo", F.explode(F.array(F.struct(F.concat("p", F.lit("/package.json")).alias("path"), text.alias("text")), F.struct(F.concat("p", F.lit("/tsconfig.json")).alias("path"), cfg.alias("text")))).alias("f"))
    every = r.select("repo", F.explode(F.array_compact(root)).alias("f")).unionByName(packed)
    return every.select("repo", "f.path", paths.file_name("f.path").alias("name"), "f.text")


def _at_root(s: SparkSession, d: str) -> DataFrame:
    return _root_files(s, d).where(~F.col("path").contains("/"))


_R = """r AS (SELECT repo, coalesce(packages, []) AS packages, lockfile, length(repo) AS n FROM repos),
pk AS (SELECT repo, n, packages, unnest(packages) AS p, generate_subscripts(packages, 1) - 1 AS i FROM r)"""
_TARGET = "CASE n % 3 WHEN 0 THEN 'ES2022' WHEN 1 THEN 'ES2022' ELSE 'ESNext' END"
_OPTIONS = f"""o AS (SELECT repo, 'root' AS name, unnest(['strict', 'target', 'module', 'declaration']) AS option, unnest([CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END, {_TARGET}, CASE WHEN n % 5 = 0 THEN 'ESNext' ELSE 'CommonJS' END, 'true']) AS value FROM r
    WHERE n % 7 <> 0 OR n % 2 = 0 UNION ALL
    SELECT repo, repo || '/' || split_part(p, '/', -1), unnest(['strict', 'target', 'module']), unnest(['true', 'ES5', CASE WHEN i % 2 = 0 THEN 'ES2022' ELSE 'Node16' END]) FROM pk)"""


@query(f"WITH {_R} SELECT repo, CASE WHEN lockfile = 'pnpm' THEN 'pnpm' WHEN lockfile = 'yarn' THEN 'yarn' ELSE 'npm' END AS tool FROM r WHERE lockfile IN ('pnpm', 'yarn', 'npm') OR n % 4 = 0")
def lockfile_tools(s: SparkSession, d: str) -> DataFrame:
    return cat.detect_tool(_at_root(s, d), cat.LOCKFILES)


_LANGUAGES = f"""{_R}, ts AS (SELECT repo, 'typescript' AS language, least(0.95, round(CASE WHEN n % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN n % 3 = 0 THEN 0.3 ELSE 0 END + CASE WHEN n % 7 <> 0 THEN 0.4 ELSE 0 END, 6))::DOUBLE AS confidence FROM r),
py AS (SELECT repo, 'python' AS language, (CASE WHEN n % 4 = 1 THEN 0.4 ELSE 0 END + CASE WHEN n % 8 = 1 THEN 0.2 ELSE 0 END)::DOUBLE AS confidence FROM r),
go AS (SELECT repo, 'go' AS language, 0.4::DOUBLE AS confidence FROM r WHERE n % 9 = 0),
lg AS (SELECT * FROM ts WHERE confidence > 0.2 UNION ALL SELECT * FROM py WHERE confidence > 0.2 UNION ALL SELECT * FROM go)"""
_MONOREPOS = """mr AS (SELECT repo, 'pnpm-workspace' AS tool, 0.95::DOUBLE AS confidence FROM r WHERE lockfile = 'pnpm' UNION ALL SELECT repo, 'yarn-workspaces', 0.85 FROM r WHERE lockfile = 'yarn'
    UNION ALL SELECT repo, 'npm-workspaces', 0.8 FROM r WHERE lockfile = 'npm' UNION ALL SELECT repo, 'turbo', 0.7 FROM r WHERE n % 3 = 1)"""


# The root tsconfig opens with a comment, so its texts count as evidence only by being there.
@query(f"WITH {_LANGUAGES} SELECT * FROM lg")
def languages(s: SparkSession, d: str) -> DataFrame:
    return cat.detect_languages(_at_root(s, d))


@query(f"WITH {_LANGUAGES} SELECT repo, arg_max(language, (confidence, language)) AS language, max(confidence) AS confidence FROM lg GROUP BY repo")
def surest_language(s: SparkSession, d: str) -> DataFrame:
    return cat.surest(cat.detect_languages(_at_root(s, d)), "language")


@query(f"WITH {_R}, {_MONOREPOS} SELECT * FROM mr")
def monorepos(s: SparkSession, d: str) -> DataFrame:
    return cat.detect_monorepos(_at_root(s, d))


@query(
    f"""WITH {_LANGUAGES}, {_MONOREPOS}, f AS (SELECT repo, list(x) AS f FROM (SELECT repo, language AS x FROM lg UNION SELECT repo, tool FROM mr) GROUP BY repo),
    b AS (SELECT repo, arg_max(language, (confidence, language)) AS best FROM lg GROUP BY repo),
    p AS (SELECT repo, CASE WHEN list_contains(f, 'pnpm-workspace') AND list_contains(f, 'typescript') THEN 'ts-pnpm' WHEN list_has_any(f, ['npm-workspaces', 'yarn-workspaces']) AND list_contains(f, 'typescript') THEN 'ts-npm'
        WHEN list_contains(f, 'python') THEN 'py-poetry' WHEN list_contains(f, 'rust') THEN 'rust-cargo' WHEN best = 'typescript' THEN 'ts-simple' ELSE 'default' END AS preset FROM f LEFT JOIN b USING (repo))
    SELECT repo, preset, CASE preset WHEN 'ts-pnpm' THEN 0.95 WHEN 'ts-npm' THEN 0.85 WHEN 'py-poetry' THEN 0.7 WHEN 'rust-cargo' THEN 0.8 WHEN 'ts-simple' THEN 0.6 ELSE 0 END::DOUBLE AS confidence FROM p"""
)
def presets(s: SparkSession, d: str) -> DataFrame:
    f = _at_root(s, d)
    return cat.choose_presets(cat.detect_languages(f), cat.detect_monorepos(f))


@query(
    f"""WITH {_R} SELECT repo, '' AS dir, repo AS name, NULL::BOOLEAN AS private, CASE WHEN n % 2 = 0 THEN 'module' END AS type, CASE WHEN n % 3 = 0 THEN '@types/node,typescript' ELSE '' END AS dependencies, NULL AS bin_names, NULL AS export_keys FROM r
    UNION ALL SELECT repo, p, repo || '/' || split_part(p, '/', -1), true, NULL, array_to_string(list_sort(list_distinct(['left-pad', repo || '/' || split_part(packages[1], '/', -1)])), ','), 'run', '.,./b' FROM pk"""
)
def package_fields(s: SparkSession, d: str) -> DataFrame:
    p = source.package_json(_root_files(s, d))
    text = lambda c: F.when(F.col(c).isNotNull(), F.array_join(c, ",")).alias(c)
    return p.select("repo", paths.directory("path").alias("dir"), "name", "private", "type", text("dependencies"), text("bin_names"), text("export_keys"))


@query(f"WITH {_R} SELECT DISTINCT repo, p AS dir FROM pk WHERE repo IN (SELECT repo FROM r WHERE lockfile IN ('pnpm', 'npm', 'yarn'))")
def workspace_dirs(s: SparkSession, d: str) -> DataFrame:
    f = _root_files(s, d)
    return source.expand_workspaces(source.package_dirs(f), source.workspaces(f.where(~F.col("path").contains("/"))))


@query(
    f"""WITH {_R}, a AS (SELECT repo, repo AS package, unnest(CASE WHEN n % 3 = 0 THEN ['@types/node', 'typescript'] ELSE [NULL] END) AS dependency FROM r
        UNION ALL SELECT repo, repo || '/' || split_part(p, '/', -1), unnest(['left-pad', repo || '/' || split_part(packages[1], '/', -1)]) FROM pk),
    d AS (SELECT DISTINCT repo, package, dependency, dependency IN (SELECT repo || '/' || split_part(p, '/', -1) FROM pk) AS own FROM a)
    SELECT repo, package, coalesce(string_agg(dependency, ',' ORDER BY dependency) FILTER (WHERE own), '') AS internal, coalesce(string_agg(dependency, ',' ORDER BY dependency) FILTER (WHERE NOT own), '') AS external FROM d GROUP BY repo, package"""
)
def workspace_topology(s: SparkSession, d: str) -> DataFrame:
    p = source.package_json(_root_files(s, d))
    w = resolve.workspace_dependencies(p.select("repo", F.col("name").alias("package"), F.explode_outer("dependencies").alias("dependency")), p.select("repo", "name"))
    return w.select("repo", "package", F.array_join("internal", ",").alias("internal"), F.array_join("external", ",").alias("external"))


def _workspaces(s: SparkSession, d: str) -> DataFrame:
    return _configured(s, d).select("repo", F.explode("packages").alias("dir"))


@query(f"WITH {_R} SELECT repo, '' AS dir, CASE WHEN n % 7 <> 0 THEN 'tsconfig.json' ELSE 'jsconfig.json' END AS path FROM r WHERE n % 7 <> 0 OR n % 2 = 0 UNION ALL SELECT DISTINCT repo, p, p || '/tsconfig.json' FROM pk")
def configs_found(s: SparkSession, d: str) -> DataFrame:
    return frontend.find_configs(_root_files(s, d), _workspaces(s, d))


def _options(s: SparkSession, d: str) -> DataFrame:
    f = _root_files(s, d)
    found = f.join(frontend.find_configs(f, _workspaces(s, d)).select("repo", "path"), ["repo", "path"], "left_semi")
    return frontend.compiler_options(found, packages=source.package_json(f).select("repo", paths.directory("path").alias("dir"), F.col("name").alias("package")))


@query(f"WITH {_R}, {_OPTIONS} SELECT repo, name, option, value FROM o")
def config_options(s: SparkSession, d: str) -> DataFrame:
    return _options(s, d).select("repo", "name", F.explode("options").alias("option", "value"))


@query(
    f"""WITH {_R}, {_OPTIONS}, names AS (SELECT DISTINCT repo, name FROM o WHERE name <> 'root'), x AS (SELECT n.repo, n.name, u.option FROM names n JOIN (SELECT DISTINCT repo, name, option FROM o) u ON u.repo = n.repo AND u.name IN (n.name, 'root') GROUP BY ALL)
    SELECT x.repo, x.name, x.option, a.value, b.value AS root_value FROM x LEFT JOIN o a ON a.repo = x.repo AND a.name = x.name AND a.option = x.option LEFT JOIN o b ON b.repo = x.repo AND b.name = 'root' AND b.option = x.option
    WHERE a.value IS DISTINCT FROM b.value"""
)
def config_deltas(s: SparkSession, d: str) -> DataFrame:
    return frontend.option_delta(_options(s, d))


@query(
    f"""WITH {_R}, {_OPTIONS}, w AS (SELECT repo, name, max(value) FILTER (WHERE option = 'strict') AS strict, max(value) FILTER (WHERE option = 'module') AS module, max(value) FILTER (WHERE option = 'declaration') AS declaration, max(value) FILTER (WHERE option = 'target') AS target FROM o GROUP BY ALL)
    SELECT count(*) AS n_configs, count(*) FILTER (WHERE strict = 'true') AS n_strict, count(*) FILTER (WHERE module IN ('ESNext', 'ES2022', 'ES2020')) AS n_esm, count(*) FILTER (WHERE declaration = 'true') AS n_declaration,
    (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT target || '=' || count(*) AS x FROM w GROUP BY target)) AS targets, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT module || '=' || count(*) AS x FROM w GROUP BY module)) AS modules FROM w"""
)
def config_totals(s: SparkSession, d: str) -> DataFrame:
    return frontend.config_summary(_options(s, d))


@query(
    f"""WITH {_R}, c AS (SELECT repo, '' AS dir, 'tsconfig.json' AS config FROM r WHERE n % 7 <> 0 UNION SELECT repo, p, p || '/tsconfig.json' FROM pk), f AS (SELECT DISTINCT repo, path FROM file_infos UNION SELECT repo, p || '/src/main.ts' FROM pk)
    SELECT f.repo, f.path, arg_max(config, length(dir)) AS config FROM f LEFT JOIN c ON c.repo = f.repo AND (dir = '' OR starts_with(f.path, dir || '/')) GROUP BY ALL"""
)
def nearest_configs(s: SparkSession, d: str) -> DataFrame:
    f = _t(s, d, "file_infos").select("repo", "path").union(_workspaces(s, d).select("repo", F.concat("dir", F.lit("/src/main.ts"))))
    return resolve.nearest_config(f, _root_files(s, d).where("name = 'tsconfig.json'"))


@query(
    r"""SELECT file_id, CASE WHEN regexp_matches(path, '(^|/)README[^/]*\.md$') THEN false WHEN regexp_matches(path, '(^|/)public/.') AND regexp_matches(path, '^services/[^/]*/public/.') THEN true WHEN regexp_matches(path, '^tests/(.*/)?[^/]*\.py(/.*)?$') THEN true
    WHEN regexp_matches(path, '^scripts/.') THEN true WHEN regexp_matches(path, '(^|/)[^/]*\.md(/.*)?$') THEN true
    ELSE regexp_matches(path, '^(node_modules|dist|build|\.turbo|\.svelte-kit|coverage|\.nyc_output|\.next|\.nuxt|target|__pycache__|\.git|\.hg|\.svn)/.') OR regexp_matches(path, '(^|/)([^/]*\.(pyc|log|tmp|swp|swo)|\.DS_Store|Thumbs\.db|\.env|\.env\.local|\.env\.[^/]*\.local)(/.*)?$') END AS ignored FROM file_infos"""
)
def ignored_files(s: SparkSession, d: str) -> DataFrame:
    rules = source.ignore_rules(["*.md", "# remark", "", "/scripts/", "tests/**/*.py", "services/*/public/", "!README*.md"])
    return _t(s, d, "file_infos").select("file_id", source.ignored("path", rules).alias("ignored"))


@query(
    r"""SELECT file_id FROM file_infos WHERE lower(split_part(path, '.', -1)) IN ('ts', 'tsx', 'js', 'jsx', 'py', 'rs', 'go') AND NOT regexp_matches(path, '\.d\.ts$|\.min\.js$|\.bundle\.js$|\.generated\.|\.snap$|\.lock$|__generated__|__snapshots__|\.test\.|\.spec\.|(?i:license)|(?i:readme)')
    AND NOT regexp_matches(regexp_replace(path, '/?[^/]*$', ''), '(^|/)(\.[^/]*|node_modules|dist|build|coverage|__pycache__|target)(/|$)')"""
)
def duplication_files(s: SparkSession, d: str) -> DataFrame:
    return source.duplication_sources(_t(s, d, "file_infos")).select("file_id")


@query(
    """SELECT edge_id, replace(chr(92) || replace(from_path, '/', chr(92)), chr(92), '/') AS posix, CASE WHEN split_part(specifier, '/', 1) LIKE '@%' AND contains(specifier, '/') THEN split_part(specifier, '/', 1) || '/' || split_part(specifier, '/', 2) ELSE split_part(specifier, '/', 1) END AS package
    FROM import_edges WHERE NOT regexp_matches(specifier, '^(\\./|\\.\\./|/)') AND specifier <> ''"""
)
def installed_packages(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "import_edges").where(~paths.is_relative("specifier") & (F.col("specifier") != ""))
    place = F.concat(F.lit("x/node_modules/"), F.when(F.col("specifier").startswith("@"), "").otherwise("@types/"), F.col("specifier"), F.lit("/i.d.ts"))
    return e.select("edge_id", paths.posix(F.concat(F.lit("\\"), F.translate("from_path", "/", "\\"))).alias("posix"), paths.package_of_installed(place).alias("package"))


# --- Budgets, validation, output ------------------------------------------------------------------------------------


def _artifacts(s: SparkSession, d: str) -> DataFrame:
    f = _t(s, d, "file_infos").groupBy("repo").agg(F.lit("files-manifest").alias("id"), F.sum("bytes").alias("size"))
    g = _t(s, d, "import_edges").groupBy("repo").agg(F.lit("import-graph").alias("id"), (F.count("*") * 100).alias("size"))
    r = _t(s, d, "repos").select("repo", F.lit("topology").alias("id"), (F.coalesce(F.size("packages"), F.lit(0)) * 300).cast("bigint").alias("size"))
    return f.unionByName(g).unionByName(r).select("repo", "id", "size", F.concat(F.lit("ts/"), "id", F.lit(".json")).alias("filename"))


_ARTIFACTS = """t AS (SELECT repo, 'files-manifest' AS id, sum(bytes)::BIGINT AS size FROM file_infos GROUP BY repo UNION ALL SELECT repo, 'import-graph', count(*) * 100 FROM import_edges GROUP BY repo
    UNION ALL SELECT repo, 'topology', coalesce(len(packages), 0) * 300 FROM repos)"""


@query(
    f"""WITH RECURSIVE {_ARTIFACTS}, v AS (SELECT *, 1000.0::DOUBLE / greatest(size, 1) * CASE WHEN id IN ('topology', 'import-graph') THEN 2.0 ELSE 1.0 END AS value FROM t WHERE size <= 60000),
    o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY value DESC, id) AS rn FROM v),
    f(repo, rn, id, used, ok) AS (SELECT repo, rn, id, size, true FROM o WHERE rn = 1 UNION ALL SELECT o.repo, o.rn, o.id, used + CASE WHEN used + size <= 80000 THEN size ELSE 0 END, used + size <= 80000 FROM f JOIN o ON o.repo = f.repo AND o.rn = f.rn + 1)
    SELECT t.repo, t.id, coalesce(ok, false) AS included, CASE WHEN ok IS NULL THEN 'over artifact budget' WHEN ok THEN 'kept' ELSE 'over total budget' END AS decision FROM t LEFT JOIN f ON f.repo = t.repo AND f.id = t.id"""
)
def artifact_budget(s: SparkSession, d: str) -> DataFrame:
    return budget.choose_artifacts(_artifacts(s, d), "repo", 80_000, 60_000).select("repo", "id", "included", "decision")


@query(
    f"""WITH {_ARTIFACTS} SELECT repo, id, id || '.json' AS filename, variant FROM t, (VALUES ('full', 1), ('short', 2), ('minimal', 3)) x(variant, k)
    WHERE k = 1 OR (k = 2 AND id IN ('topology', 'files-manifest', 'import-graph')) OR (k = 3 AND id = 'import-graph')"""
)
def variants(s: SparkSession, d: str) -> DataFrame:
    return budget.variants(_artifacts(s, d)).select("repo", "id", "filename", "variant")


@query(
    f"""SELECT rule, count(*) FILTER (WHERE broken) AS n FROM (
    SELECT unnest(['path.required', 'bytes.range', 'loc.range', 'kind.enum', 'bucket.enum', 'sha256.pattern', 'large-file', 'empty-code']) AS rule,
    unnest([path IS NULL OR path = '', bytes IS NULL OR bytes < 0, loc IS NULL OR loc < 0, kind IS NULL OR kind NOT IN ('code', 'test', 'config', 'docs', 'asset'), bucket IS NULL OR bucket NOT IN ('internal', 'public', 'unknown'),
        coalesce(NOT regexp_matches(sha256, '^([0-9a-f]{{64}}|skipped-large-file)$'), false), coalesce(bytes > 1000000, false), coalesce(kind = 'code' AND loc = 0, false)]) AS broken FROM file_infos) GROUP BY rule"""
)
def validation_counts(s: SparkSession, d: str) -> DataFrame:
    return validate.counts(_t(s, d, "file_infos"), validate.file_rules() | validate.file_warnings())


@query(
    """SELECT json_object('context', CASE WHEN context IS NULL THEN NULL ELSE json_object('after', context.after, 'before', context.before) END, 'kind', symbol_kind, 'reasons', reasons, 'slice_id', slice_id,
    'tokens', CASE WHEN tokens IS NULL THEN NULL ELSE json_object('average', tokens.average, 'conservative', tokens.conservative, 'optimistic', tokens.optimistic) END)::VARCHAR AS json FROM code_slices"""
)
def canonical_json(s: SparkSession, d: str) -> DataFrame:
    return emit.canonical_json(_t(s, d, "code_slices").select("tokens", "slice_id", "reasons", F.col("symbol_kind").alias("kind"), "context"))


@query("SELECT slice_id, strlen(json_object('context', CASE WHEN context IS NULL THEN NULL ELSE json_object('before', context.before, 'after', context.after) END, 'kind', symbol_kind)::VARCHAR)::BIGINT AS n_bytes FROM code_slices")
def json_sizes(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "code_slices").select("slice_id", tx.json_size(F.struct("context", F.col("symbol_kind").alias("kind"))).alias("n_bytes"))


@query(
    """WITH t AS (SELECT 'repos' AS id, json_object('lockfile', lockfile, 'repo', repo)::VARCHAR AS text FROM repos UNION ALL SELECT 'edges', json_object('from_path', from_path, 'to_path', to_path)::VARCHAR FROM import_edges),
    n AS (SELECT count(DISTINCT id) AS k, sum(strlen(text) + 1) AS b, sum(length(text) + 1) AS c FROM t)
    SELECT k AS n_artifacts, b::BIGINT AS total_bytes, ceil(c / 3)::BIGINT AS conservative, ceil(c / 5)::BIGINT AS optimistic, floor((ceil(c / 3) + ceil(c / 5)) / 2 + 0.5)::BIGINT AS average FROM n"""
)
def artifact_totals(s: SparkSession, d: str) -> DataFrame:
    part = lambda name, df: emit.canonical_json(df, "text").select(F.lit(name).alias("id"), "text")
    return emit.artifact_totals(part("repos", _t(s, d, "repos").select("repo", "lockfile")).unionByName(part("edges", _t(s, d, "import_edges").select("from_path", "to_path"))))


@query(
    f"""WITH r AS (SELECT file_id AS no, unnest(['path.required', 'bytes.range', 'loc.range', 'kind.enum', 'bucket.enum', 'sha256.pattern']) AS rule, unnest([path IS NULL OR path = '', bytes IS NULL OR bytes < 0, loc IS NULL OR loc < 0,
        kind IS NULL OR kind NOT IN ('code', 'test', 'config', 'docs', 'asset'), bucket IS NULL OR bucket NOT IN ('internal', 'public', 'unknown'), coalesce(NOT regexp_matches(sha256, '^([0-9a-f]{{64}}|skipped-large-file)$'), false)]) AS broken FROM file_infos)
    SELECT no, '[' || no || '].' || rule AS field, rule FROM r WHERE broken"""
)
def ndjson_findings(s: SparkSession, d: str) -> DataFrame:
    f = _t(s, d, "file_infos")
    record = F.struct("path", "bytes", "sha256", "loc", "kind", "bucket", F.col("ignore_reason").alias("ignoreReason"))
    return validate.ndjson_findings(f.select(F.col("file_id").alias("no"), F.to_json(record, {"ignoreNullFields": "false"}).alias("value")))


@query("SELECT true AS valid, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM file_infos")
def ndjson_round_trip(s: SparkSession, d: str) -> DataFrame:
    f = _t(s, d, "file_infos").select("path", "bytes", "sha256", "loc", "kind", "bucket", F.col("ignore_reason").alias("ignoreReason"))
    return validate.ndjson(emit.canonical_json(f, "value")).groupBy("valid").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT repo, strftime(date_trunc('day', created_at AT TIME ZONE 'UTC'), '%Y-%m-%dT%H:%M:%S.000Z') AS day FROM repos")
def utc_days(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "repos").select("repo", tx.utc_day("created_at").alias("day"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
