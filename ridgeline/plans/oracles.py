"""DuckDB SQL for the registered queries: the same results computed another way."""

from __future__ import annotations

from ridgeline.functions import text as T

_STEM = T.stem_pattern()
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_STRIP = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return _STRIP.format(x)


def tokens(x: str) -> str:
    one = f"CASE WHEN length(t) >= 5 AND regexp_matches(t, '[а-яА-ЯёЁ]') THEN regexp_replace(t, '{_STEM}', '\\1') ELSE t END"
    return f"list_transform(regexp_extract_all(lower(coalesce({x}, '')), '{T.TOKEN}'), lambda t: {one})"


def distinct(x: str) -> str:
    """Distinct elements in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def terms(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"


def caption(x: str) -> str:
    return f"regexp_matches(lower({strip(x)}), '^({'|'.join(T.CAPTION_WORDS)})')"


def bullets(x: str) -> str:
    t = strip(x)
    n = f"(length({t}) - length(translate({t}, '•—-*·', '')))"
    lines = f"(length({t}) - length(replace({t}, chr(10), '')))"
    return f"({n} >= 3 OR (starts_with({t}, '•') AND {lines} >= 1) OR ({lines} >= 2 AND {n} >= 1))"


def table_header(x: str) -> str:
    t = strip(x)
    words = f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')"
    upper = f"len(list_filter({words}, lambda w: regexp_matches(w, '^\\p{{Lu}}')))"
    return f"(NOT regexp_matches({t}, '[.!?;]') AND len({words}) >= 5 AND ({upper} * 2 >= len({words}) OR len({words}) >= 10))"


def heading(x: str) -> str:
    t = strip(x)
    letters = f"length(regexp_replace({t}, '[^\\p{{L}}\\s]', '', 'g'))"
    return f"(length({t}) > 0 AND length({t}) <= 80 AND NOT regexp_matches({t}, '[.!?]') AND {letters} * 10 >= length({t}) * 9 AND regexp_matches({t}, '^\\p{{Lu}}'))"


def incomplete(x: str) -> str:
    t = f"lower({strip(x)})"
    return f"({t} <> '' AND (" + " OR ".join(f"regexp_matches({t}, '{p}')" for p in T.INCOMPLETE) + "))"


def dedupe(x: str) -> str:
    return r"regexp_replace(regexp_replace(" + strip(f"lower({x})") + r", '\s+', ' ', 'g'), '^[ \t\n\r.,;:!—-]+|[ \t\n\r.,;:!—-]+$', '', 'g')"


def alpha(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN 0.0 ELSE length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length({x}) END"


def noise(x: str) -> str:
    s = strip(x)
    signs = ", ".join(f"'{p}'" for p in T.PUNCTUATION_ONLY)
    return f"({x} IS NULL OR {s} = '' OR {s} IN ({signs}) OR regexp_matches({s}, '^\\p{{Nd}}{{1,3}}$') OR (length({s}) <= 2 AND regexp_matches({s}, '^[^\\p{{L}}\\p{{N}}_\\s]$')) OR (length({s}) < 10 AND {alpha(x)} < 0.2))"


def evidence(x: str) -> str:
    return strip(f"regexp_replace(lower(regexp_replace(coalesce({x}, ''), '{T.PLACEHOLDER}', ' ', 'g')), '\\s+', ' ', 'g')")


WS = strip(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g')")


def n_tokens(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'))"


def snippet(x: str) -> str:
    return strip(f"regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g')")


def words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({snippet(x)}, ' '), lambda w: w <> ''))"


def vector(x: str) -> str:
    """Token counts by md5 bucket; null without tokens."""
    b = f"list_transform({tokens(x)}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64)"
    return f"CASE WHEN len({tokens(x)}) > 0 THEN list_transform(range(64), lambda i: len(list_filter({b}, lambda v: v = i))::DOUBLE) END"


def cosine(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN -1.0 ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END"


P = "p AS (SELECT doc_id AS id, text FROM documents)"
Q = "q AS (SELECT item_id AS qid, text AS query FROM benchmark)"
LINES = f"""l0 AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM documents),
lines AS (SELECT doc_id, (unnest(range(len(l))))::INT AS pos, unnest(l) AS text FROM l0)"""
NODES = f"""{LINES},
nodes AS (SELECT 'D' || doc_id || '.' || (pos // 8) || '.' || pos AS node_id,
  CASE WHEN pos % 8 = 0 THEN 'D' || doc_id || '.' || (pos // 8) ELSE 'D' || doc_id || '.' || (pos // 8) || '.s' || ((pos % 8) // 4) END AS section_id,
  CASE WHEN {caption('text')} THEN 'caption' WHEN {bullets('text')} THEN 'list_item' ELSE 'chunk' END AS node_type, text, pos, doc_id FROM lines)"""
SECTIONS = f"""{NODES},
loc AS (SELECT section_id, string_agg(text, chr(10) ORDER BY pos) AS local_text FROM nodes GROUP BY 1),
cnt AS (SELECT doc_id, len(l) AS n FROM l0),
blk AS (SELECT doc_id, n, unnest(range(0, (n + 7) // 8)) AS b FROM cnt),
s0 AS (SELECT 'D' || doc_id AS section_id, 0 AS level, NULL AS parent_id, 0 AS child_pos, doc_id FROM cnt
  UNION ALL SELECT 'D' || doc_id || '.' || b, 1, 'D' || doc_id, b, doc_id FROM blk
  UNION ALL SELECT 'D' || doc_id || '.' || b || '.s0', 2, 'D' || doc_id || '.' || b, 0, doc_id FROM blk WHERE n > 8 * b + 1
  UNION ALL SELECT 'D' || doc_id || '.' || b || '.s1', 2, 'D' || doc_id || '.' || b, 1, doc_id FROM blk WHERE n > 8 * b + 4),
sections AS (SELECT s0.*, coalesce(local_text, '') AS local_text FROM s0 LEFT JOIN loc USING (section_id))"""
SUBTREE = f"""{SECTIONS},
sub AS (SELECT a.section_id, coalesce(string_agg(n.text, chr(10) ORDER BY n.pos), '') AS subtree_text
  FROM sections a LEFT JOIN nodes n ON n.doc_id = a.doc_id AND (a.level = 0 OR n.section_id = a.section_id OR (a.level = 1 AND starts_with(n.section_id, a.section_id || '.s'))) GROUP BY 1)"""
EDGES = f"""{SECTIONS},
dup AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents),
edges AS (SELECT parent_id AS src, section_id AS dst, 'HAS_SUBSECTION' AS rel, child_pos::BIGINT AS edge_pos FROM sections WHERE parent_id IS NOT NULL
  UNION ALL SELECT section_id, node_id, CASE WHEN node_type = 'list_item' THEN 'HAS_ITEM' ELSE 'HAS_CHUNK' END, (pos + 1000)::BIGINT FROM nodes
  UNION ALL SELECT 'D' || first, 'D' || doc_id, 'LINKS_TO', doc_id + 1000000 FROM dup WHERE doc_id <> first)"""


def bm25(passages: str = "p", k: int = 10, name: str = "hits") -> str:
    x = name
    return f"""{x}_d AS (SELECT id, {tokens('text')} AS t FROM {passages}), {x}_l AS (SELECT id, t, len(t) AS dl FROM {x}_d WHERE len(t) > 0),
{x}_c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {x}_l),
{x}_q AS (SELECT DISTINCT qid, unnest({terms('query')}) AS term FROM q),
{x}_tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(t) AS term FROM {x}_l) GROUP BY ALL),
{x}_df AS (SELECT term, count(*) AS df FROM {x}_tf GROUP BY 1),
{x}_s AS (SELECT qid, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {x}_q JOIN {x}_tf USING (term) JOIN {x}_df USING (term), {x}_c GROUP BY 1, 2),
{x} AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM {x}_s QUALIFY rank <= {k})"""


RARE = f"""rt AS (SELECT qid, term, min(pos) AS pos FROM (SELECT qid, unnest({terms('query')}) AS term, unnest(range(len({terms('query')}))) AS pos FROM q) GROUP BY 1, 2),
must AS (SELECT qid, list(term ORDER BY df, pos)[1:2] AS must FROM rt JOIN hits_df USING (term) GROUP BY 1)"""


def relaxed(source: str, passes: list[str], threshold: int, name: str = "chosen") -> str:
    """source has qid, id, score, rank, text, key and columns p1, p2, p3."""
    number = "CASE WHEN p1 THEN 1 " + ("WHEN least(strict, 10) < 4 AND p2 THEN 2 " if threshold else "") + "WHEN p3 THEN 3 END"
    return f"""{name}_a AS (SELECT *, {passes[0]} AS p1, {passes[1]} AS p2, {passes[2]} AS p3 FROM {source}),
{name}_n AS (SELECT qid, count(DISTINCT key) FILTER (p1) AS strict FROM {name}_a GROUP BY 1),
{name}_b AS (SELECT *, {number} AS pass FROM {name}_a JOIN {name}_n USING (qid)),
{name}_c AS (SELECT * FROM {name}_b WHERE pass IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY pass, rank) = 1),
{name} AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY pass, rank) AS r FROM {name}_c QUALIFY r <= 10)"""


_CLEAN = f"(t <> '' AND NOT {caption('t')} AND NOT {table_header('t')} AND NOT {heading('t')})"
BM25H = f"""{bm25(k=120)}, {RARE},
cand AS (SELECT h.qid, h.id, h.score, h.rank, {strip('p.text')} AS t, {dedupe('p.text')} AS key, m.must FROM hits h JOIN p USING (id) LEFT JOIN must m USING (qid)),
{relaxed('cand', [f"{_CLEAN} AND NOT ends_with(t, ':') AND length(t) >= 80 AND (must IS NULL OR list_has_any({tokens('t')}, must))", f"{_CLEAN} AND NOT ends_with(t, ':') AND length(t) >= 80", f"{_CLEAN} AND NOT ends_with(t, ':') AND length(t) >= 40"], 4)}"""
DENSE_TEXT = f"""dv AS (SELECT id, text, {vector('text')} AS v FROM p), qv AS (SELECT qid, query, {vector('query')} AS w FROM q),
ds AS (SELECT qid, id, {cosine('w', 'v')} AS score FROM dv, qv),
dh AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM ds QUALIFY rank <= 60)"""
SCORES = f"""{SUBTREE}, {Q}, qv AS (SELECT qid, {vector('query')} AS w FROM q),
sv AS (SELECT section_id, parent_id, child_pos, level, {strip('local_text')} <> '' AS has_text, {vector('local_text')} AS a, {vector('subtree_text')} AS b FROM sections JOIN sub USING (section_id)),
sc AS (SELECT qid, section_id, parent_id, child_pos, level, has_text, {cosine('w', 'a')} AS local, {cosine('w', 'b')} AS subtree FROM sv, qv),
roots AS (SELECT qid, section_id, subtree, row_number() OVER (PARTITION BY qid ORDER BY round(subtree, 6) DESC, section_id) AS rank FROM sc WHERE level = 1 QUALIFY rank <= 3)"""


def drill_ctes(mode: str, scores: str = SCORES) -> str:
    scaled = lambda x: f"(CASE WHEN qmax > qmin THEN ({x} - qmin) / (qmax - qmin) ELSE {x} END)" if mode == "percentile" else x
    taken = "pos <= greatest(1, ceil(n * 0.5))" if mode == "rank" else f"pos <= 2 AND {scaled('best')} >= 0.45"
    return f"""WITH RECURSIVE {scores},
s AS (SELECT qid, section_id, parent_id, child_pos, level, has_text, round(local, 6) AS local, round(subtree, 6) AS subtree FROM sc),
lim AS (SELECT qid, min(v) AS qmin, max(v) AS qmax FROM (SELECT qid, local AS v FROM s WHERE local > -1 UNION ALL SELECT qid, subtree FROM s WHERE subtree > -1) GROUP BY 1),
ch AS (SELECT *, row_number() OVER (PARTITION BY qid, parent_id ORDER BY subtree DESC, child_pos) AS pos, count(*) OVER (PARTITION BY qid, parent_id) AS n, max(subtree) OVER (PARTITION BY qid, parent_id) AS best FROM s WHERE parent_id IS NOT NULL),
bc AS (SELECT qid, parent_id AS section_id, max(subtree) AS best_child FROM ch GROUP BY 1, 2),
fl AS (SELECT s.*, has_text AND {scaled('local')} >= 0.35 AND local >= coalesce(best_child, -1.0) - 0.05 AS is_seed FROM s LEFT JOIN bc USING (qid, section_id) JOIN lim USING (qid)),
op AS (SELECT ch.qid, ch.parent_id, ch.section_id FROM ch JOIN lim USING (qid) JOIN fl ON fl.qid = ch.qid AND fl.section_id = ch.parent_id AND NOT fl.is_seed WHERE {taken}),
re AS (SELECT qid, section_id FROM roots UNION SELECT op.qid, op.section_id FROM op JOIN re ON op.qid = re.qid AND op.parent_id = re.section_id),
seeds AS (SELECT qid, section_id, local FROM fl WHERE is_seed AND (qid, section_id) IN (SELECT qid, section_id FROM re))"""


def drill(mode: str) -> str:
    return drill_ctes(mode) + "\nSELECT qid, section_id, round(local, 4) AS local FROM seeds"


SEEDS = f"{EDGES}, {P}, {Q}, {bm25(k=3, name='seed')}, sd AS (SELECT qid, 'D' || id AS node FROM seed)"


def bfs(where: str = "") -> str:
    return f"""{SEEDS}, e AS (SELECT * FROM edges {where}),
b1 AS (SELECT DISTINCT qid, dst AS node FROM sd JOIN e ON src = node), b2 AS (SELECT DISTINCT qid, dst AS node FROM b1 JOIN e ON src = node), b3 AS (SELECT DISTINCT qid, dst AS node FROM b2 JOIN e ON src = node),
bfs AS (SELECT qid, node, min(dist) AS dist FROM (SELECT qid, node, 0 AS dist FROM sd UNION ALL SELECT qid, node, 1 FROM b1 UNION ALL SELECT qid, node, 2 FROM b2 UNION ALL SELECT qid, node, 3 FROM b3) GROUP BY 1, 2)"""


def node_scores(full: bool = True, k: int = 20, reach: str | None = None) -> str:
    sim = cosine("w", "v")
    total = f"{sim} + 0.3 * (CASE node_type WHEN 'list_item' THEN 1.0 WHEN 'chunk' THEN 0.6 WHEN 'caption' THEN 0.2 ELSE 0 END) + 0.15 * (CASE level WHEN 1 THEN 0.1 WHEN 2 THEN 0.2 WHEN 3 THEN 0.3 ELSE 0 END) - 0.2 * dist"
    return f"""{reach or bfs()}, nv AS (SELECT node_id, section_id, node_type, {vector('text')} AS v FROM nodes WHERE node_id IN (SELECT node FROM bfs)), qv AS (SELECT qid, {vector('query')} AS w FROM q),
ns AS (SELECT qid, node_id, section_id, node_type, {total if full else sim} AS score FROM nv JOIN bfs ON node = node_id JOIN qv USING (qid) JOIN sections USING (section_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, node_id) AS rank FROM ns QUALIFY rank <= {k})"""


WINDOWS = f"""{node_scores()},
ck AS (SELECT section_id, node_id, pos, text, row_number() OVER (PARTITION BY section_id ORDER BY pos) - 1 AS ap, count(*) OVER (PARTITION BY section_id) AS n FROM nodes WHERE node_type = 'chunk'),
sp AS (SELECT qid, ck.section_id, ck.node_id, rank, score, ap,
  CASE WHEN least(ap + 2, n - 1) + 1 > 8 THEN greatest(0, ap - 2) ELSE 0 END AS lo, least(ap + 2, n - 1) AS hi FROM top JOIN ck USING (node_id)),
mk AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY qid, section_id ORDER BY lo, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f FROM sp),
il AS (SELECT *, sum(f) OVER (PARTITION BY qid, section_id ORDER BY lo, rank ROWS UNBOUNDED PRECEDING) AS isl FROM mk),
mg AS (SELECT qid, section_id, isl, min(lo) AS lo, max(hi) AS hi, max(score) AS score, min(rank) AS rk, list(node_id ORDER BY rank) AS anchors FROM il GROUP BY 1, 2, 3),
win AS (SELECT qid, mg.section_id, lo, hi, score, rk, anchors, list(node_id ORDER BY ap) AS members, string_agg(text, chr(10) ORDER BY ap) AS text FROM mg JOIN ck ON ck.section_id = mg.section_id AND ap BETWEEN lo AND hi GROUP BY ALL),
wr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, rk, lo) AS rank FROM win)"""
GOLD = f"""ge AS (SELECT qid, query, {evidence('query')} AS n FROM q), gp AS (SELECT id, {evidence('text')} AS t FROM p),
gx AS (SELECT DISTINCT qid, id FROM ge JOIN gp ON n = t WHERE n <> ''),
gold AS (SELECT * FROM gx UNION SELECT qid, id FROM ge, gp WHERE length(n) >= 60 AND len(regexp_extract_all(n, '{T.LETTERS_DIGITS}')) >= 5 AND qid NOT IN (SELECT qid FROM gx) AND t <> '' AND (contains(t, n) OR contains(n, t)))"""
GOLD_LINES = f"gl AS (SELECT qid, node_id AS id FROM gold JOIN q USING (qid) JOIN nodes ON nodes.doc_id = gold.id WHERE len(list_intersect({words('nodes.text')}, {words('query')}))::DOUBLE / len({words('query')}) >= 0.3)"


def ideal(n: str) -> str:
    return f"list_sum(list_transform(range(1, ({n})::BIGINT + 1), lambda i: 1 / log2(i + 1)))"


def metrics(run: str, gold: str, unit: str = "{}") -> str:
    u = unit.format("id")
    return f"""mu AS (SELECT DISTINCT qid, {u} AS u FROM {gold}), mn AS (SELECT qid, count(*) AS n FROM mu GROUP BY 1),
mr AS (SELECT r.qid, {unit.format('r.id')} AS u, rank FROM {run} r), mh AS (SELECT mr.*, mu.u IS NOT NULL AS hit FROM mr LEFT JOIN mu USING (qid, u)),
ma AS (SELECT qid, count(DISTINCT u) FILTER (hit AND rank <= 5) AS h5, count(DISTINCT u) FILTER (hit AND rank <= 10) AS h10, count(*) FILTER (rank <= 10) AS k, min(rank) FILTER (hit) AS f, sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 10) AS dcg, count(*) AS c FROM mh GROUP BY 1),
met AS (SELECT qid, coalesce(h5 / n, 0) AS recall_5, coalesce(h10 / n, 0) AS recall_10, coalesce(1 / f, 0) AS mrr, coalesce(dcg / {ideal('least(n, 10)')}, 0) AS ndcg, coalesce((k - h10) / k, 0) AS noise, coalesce(c, 0) AS retrieved FROM mn LEFT JOIN ma USING (qid))"""


def walked(sql: str, k: int) -> str:
    """Scores of what is reached from ``sd``, without the vectors that the seeds' part has already."""
    return node_scores(k=k, reach=sql).replace(f" qv AS (SELECT qid, {vector('query')} AS w FROM q),\nns AS", "\nns AS")


WALK = walked(drill_ctes("absolute") + EDGES.removeprefix(SECTIONS) + ",\nsd AS (SELECT qid, section_id AS node FROM seeds), " + bfs().removeprefix(SEEDS + ", "), 20)
_DOCS = f"{P}, {bm25(k=50, name='base')}, docs AS (SELECT qid, id, rank FROM base WHERE rank <= 5)"
_SCOPED = SCORES.replace(f"{Q},", f"{Q}, {_DOCS},", 1).replace("sv AS (SELECT section_id,", "sv AS (SELECT doc_id, section_id,").replace("FROM sv, qv)", "FROM sv JOIN docs ON docs.id = sv.doc_id JOIN qv USING (qid))")
_OWN = "AND (qid, regexp_extract(dst, '^D([0-9]+)', 1)::BIGINT) IN (SELECT qid, id FROM docs)"
_INSIDE = f"""sd AS (SELECT qid, section_id AS node FROM seeds UNION ALL SELECT qid, section_id FROM roots WHERE qid NOT IN (SELECT qid FROM seeds)
  UNION ALL SELECT qid, 'D' || id FROM docs WHERE qid NOT IN (SELECT qid FROM seeds) AND qid NOT IN (SELECT qid FROM roots)),
""" + bfs().removeprefix(SEEDS + ", ").replace("ON src = node)", f"ON src = node WHERE true {_OWN})")
HYBRID = walked(drill_ctes("absolute", _SCOPED) + EDGES.removeprefix(SECTIONS) + ",\n" + _INSIDE, 10)
WINDOW_TAIL = WINDOWS.removeprefix(node_scores())


def capped(limit: int = 25) -> str:
    out = f"{SEEDS.replace('AS node FROM seed', 'AS node, rank FROM seed')}, n0 AS (SELECT qid, node, 0 AS dist, rank::BIGINT AS rank FROM sd)"
    for k in (1, 2, 3):
        out += f""",
c{k} AS (SELECT f.qid, dst AS node, row_number() OVER (PARTITION BY f.qid ORDER BY f.rank, edge_pos, dst) AS pl FROM n{k - 1} f JOIN edges ON f.node = src WHERE f.dist = {k - 1}),
f{k} AS (SELECT qid, node, min(pl) AS pl FROM c{k} WHERE (qid, node) NOT IN (SELECT qid, node FROM n{k - 1}) GROUP BY 1, 2),
h{k} AS (SELECT qid, count(*) AS have, max(rank) AS last FROM n{k - 1} GROUP BY 1),
n{k} AS (SELECT * FROM n{k - 1} UNION ALL SELECT qid, node, {k}, last + k FROM (SELECT qid, node, last, have, row_number() OVER (PARTITION BY qid ORDER BY pl) AS k FROM f{k} JOIN h{k} USING (qid)) WHERE k <= {limit} - have)"""
    return out


CONTEXTS = f"""{GOLD_LINES}, cx AS (SELECT qid, list_sort(list(DISTINCT gl.id)) AS gold_ids, min('D' || nodes.doc_id) AS doc_id FROM gl JOIN nodes ON node_id = gl.id GROUP BY 1),
np AS (SELECT node_id AS id, text FROM nodes), {bm25('np', 10, 'lh')}, ev AS (SELECT qid, e, {evidence('e')} AS n FROM (SELECT qid, unnest(string_split(query, chr(10))) AS e FROM q) JOIN cx USING (qid)),
it AS (SELECT qid, lh.id, text, rank, {evidence('text')} AS t FROM lh JOIN np USING (id) JOIN cx USING (qid))"""
_NODE_SECTION = r"regexp_replace({}, '^(.*)\.(\d+)\.(\d+)$', '\1.\2')"
_NODE_DOC = r"regexp_replace({}, '^(.*)\.(\d+)\.(\d+)$', '\1')"
_GU = {
    "strict_chunk": ("SELECT DISTINCT qid, unnest(gold_ids) AS u FROM cx", "SELECT it.qid, it.id, rank, it.id AS u FROM it JOIN cx USING (qid) WHERE list_contains(gold_ids, it.id)"),
    "same_section": (f"SELECT DISTINCT qid, {_NODE_SECTION.format('g')} AS u FROM (SELECT qid, unnest(gold_ids) AS g FROM cx)", f"SELECT it.qid, it.id, rank, {_NODE_SECTION.format('it.id')} AS u FROM it JOIN gu ON gu.qid = it.qid AND gu.u = {_NODE_SECTION.format('it.id')}"),
    "contains_evidence": ("SELECT DISTINCT qid, n AS u FROM ev WHERE n <> ''", "SELECT it.qid, it.id, rank, u FROM it JOIN gu USING (qid) WHERE contains(t, u) OR contains(u, t)"),
    "text_overlap_30": ("SELECT DISTINCT qid, n AS u FROM ev WHERE n <> ''", f"SELECT it.qid, it.id, rank, n AS u FROM it JOIN ev USING (qid) WHERE n <> '' AND len({words('e')}) > 0 AND len(list_intersect({words('text')}, {words('e')}))::DOUBLE / len({words('e')}) >= 0.3"),
    "same_doc": ("SELECT qid, doc_id AS u FROM cx", f"SELECT it.qid, it.id, rank, doc_id AS u FROM it JOIN cx USING (qid) WHERE {_NODE_DOC.format('it.id')} = doc_id"),
}
_GU["source_id"] = _GU["strict_chunk"]


def criterion(name: str, tag: str) -> str:
    """CTEs that end in met{tag}: (qid, recall_5, recall_10, mrr, ndcg, noise, retrieved)."""
    units, matches = _GU[name]
    t = tag
    return f"""gu{t} AS ({units}), mu{t} AS (SELECT DISTINCT qid, u, rank FROM ({matches.replace('gu ', f'gu{t} ').replace('gu.', f'gu{t}.')})), sz{t} AS (SELECT qid, count(*) AS n FROM gu{t} GROUP BY 1),
fi{t} AS (SELECT qid, u, min(rank) AS rank FROM mu{t} GROUP BY 1, 2), ga{t} AS (SELECT qid, rank, count(*) AS new FROM fi{t} GROUP BY 1, 2),
pe{t} AS (SELECT qid, sum(new) FILTER (rank <= 5) AS h5, sum(new) FILTER (rank <= 10) AS h10, min(rank) FILTER (rank <= 10) AS f, sum(1 / log2(rank + 1)) FILTER (rank <= 10) AS dcg, count(*) FILTER (rank <= 10) AS g FROM ga{t} GROUP BY 1),
rt{t} AS (SELECT qid, count(*) AS r FROM it WHERE rank <= 10 GROUP BY 1),
met{t} AS (SELECT cx.qid, CASE WHEN n IS NULL THEN 0 ELSE coalesce(h5 / n, 0) END AS recall_5, CASE WHEN n IS NULL THEN 0 ELSE coalesce(h10 / n, 0) END AS recall_10, coalesce(1 / f, 0) AS mrr, CASE WHEN n IS NULL THEN 0 ELSE coalesce(dcg / {ideal('least(n, 10)')}, 0) END AS ndcg,
  CASE WHEN n IS NULL THEN 0 ELSE coalesce((r - coalesce(g, 0)) / r, 0) END AS noise, CASE WHEN n IS NULL THEN 0 ELSE coalesce(r, 0) END AS retrieved FROM cx LEFT JOIN sz{t} USING (qid) LEFT JOIN pe{t} USING (qid) LEFT JOIN rt{t} USING (qid))"""


_MET = "qid, round(recall_5, 4) AS recall_5, round(recall_10, 4) AS recall_10, round(mrr, 4) AS mrr, round(ndcg, 4) AS ndcg, round(noise, 4) AS noise"
RUNS = f"""{P}, {Q}, {bm25(name='base')}, {BM25H}, {DENSE_TEXT},
runs AS (SELECT 'bm25' AS method, qid, id, rank FROM base UNION ALL SELECT 'bm25_heuristic', qid, id, r FROM chosen UNION ALL SELECT 'dense', qid, id, rank FROM dh WHERE rank <= 10)"""
PACKED = f"""WITH RECURSIVE {RUNS},
it AS (SELECT method, qid, list({{'id': id, 'n': {n_tokens('text')}}} ORDER BY rank) AS x FROM runs JOIN p USING (id) WHERE {strip('text')} <> '' GROUP BY 1, 2),
st AS (SELECT method, qid, x, 0 AS i, 0 AS total, []::STRUCT(id VARCHAR, n BIGINT)[] AS kept FROM it
  UNION ALL SELECT method, qid, x, i + 1, CASE WHEN total + x[i + 1].n <= 2000 THEN total + x[i + 1].n ELSE total END, CASE WHEN total + x[i + 1].n <= 2000 THEN list_append(kept, {{'id': x[i + 1].id::VARCHAR, 'n': x[i + 1].n}}) ELSE kept END FROM st WHERE i < len(x)),
pk AS (SELECT method, qid, unnest(kept).id AS id, unnest(range(1, len(kept) + 1)) AS rank, unnest(kept).n AS tokens FROM st WHERE i = len(x))"""
SIMPLE = f"""{Q}, cmp AS (SELECT * FROM (VALUES (0, 'bm25', 'bm25_heuristic'), (1, 'bm25', 'dense'), (2, 'bm25_heuristic', 'dense')) t(idx, first, second)), per AS (SELECT unnest(['AB', 'BA']) AS perm),
pr0 AS (SELECT idx, first, second, qid, perm, row_number() OVER (ORDER BY idx, qid, perm) AS k FROM cmp, q, per),
pr AS (SELECT 'p' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END || '_' || qid || '_' || perm AS pair_id, first || '_vs_' || second AS comparison_id, qid, perm, first, second FROM pr0)"""


def h(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 7))::BIGINT"


DECISIONS = f"""{SIMPLE}, jd AS (SELECT unnest(['j1', 'j2', 'j3']) AS judge), ax AS (SELECT unnest(['relevance', 'sufficiency', 'cleanliness']) AS axis),
de AS (SELECT pair_id, comparison_id, qid, perm, judge, {h('pair_id || judge')} AS h, CASE WHEN {h('pair_id || judge')} % 17 = 0 THEN 'error' ELSE 'ok' END AS status FROM pr, jd),
la AS (SELECT de.*, axis, ['A', 'B', 'equal'][{h('pair_id || judge || axis')} % 3 + 1] AS label FROM de, ax WHERE status = 'ok'),
vo AS (SELECT *, CASE WHEN label = 'equal' THEN 'equal' WHEN (perm = 'AB') = (label = 'A') THEN 'first' ELSE 'second' END AS vote FROM la),
ou0 AS (SELECT comparison_id, qid, axis, count(*) FILTER (vote = 'first') AS first, count(*) FILTER (vote = 'second') AS second, count(*) FILTER (vote = 'equal') AS equal, count(*) AS n FROM vo GROUP BY 1, 2, 3),
ou AS (SELECT *, CASE WHEN first >= 4 THEN 'first' WHEN second >= 4 THEN 'second' ELSE 'tie' END AS outcome FROM ou0),
mn AS (SELECT pair_id, axis, ['A', 'B', 'equal'][{h('pair_id || axis')} % 3 + 1] AS manual FROM pr, ax)"""
CHOICES = f"{Q}, jd AS (SELECT unnest(['j1', 'j2', 'j3']) AS judge), ch AS (SELECT qid, judge, ['bm25', 'bm25_heuristic', 'dense', ''][{h('qid || judge')} % 4 + 1] AS method, {h('qid || judge')} % 6 AS score FROM q, jd), cc AS (SELECT qid, CASE WHEN method = '' THEN '__TIE_OR_EMPTY__' ELSE method END AS method, count(*) AS v FROM ch GROUP BY ALL)"


METRICS = ["relevance", "usefulness_for_logic", "coherence", "noise", "overall"]
FIVE = f"""{Q}, fm AS (SELECT qid, unnest(['bm25', 'bm25_heuristic', 'chunks', 'dense', 'windows']) AS method FROM q),
fl AS (SELECT qid, method, md5(qid || method) AS context, chr((64 + row_number() OVER (PARTITION BY qid ORDER BY sha256('42|' || qid || '|' || method)))::INT) AS letter FROM fm)"""
FIVE_RUNS = f"""{FIVE}, rl AS (SELECT qid, judge, letter, method, {h('qid || judge')} % 11 <> 0 AS ok, ['A', 'B', 'C', 'D', 'E', ''][{h('qid || judge')} % 6 + 1] AS winner, {h("qid || judge || 'fail' || letter")} % 3 = 0 AS fail,
  """ + ", ".join(f"{h(f'qid || judge || {chr(39)}{m}{chr(39)} || letter')} % 6 AS {m}" for m in METRICS) + " FROM fl, (SELECT unnest(['j1', 'j2', 'j3']) AS judge))"
_SECTION = r"regexp_replace({}, '^(.*)\.(\d+)\.(\d+)$', '\1.\2')"
_WR = "WITH " + WINDOWS

ORACLE_SQL: dict[str, str] = {
    "tokenize_stem": f"SELECT doc_id, len({tokens('text')})::INT AS n_tokens, len(list_distinct({tokens('text')}))::INT AS n_distinct, md5(array_to_string({tokens('text')}, ' ')) AS digest FROM documents",
    "query_terms": f"WITH {Q}, t AS (SELECT qid, {terms('query')} AS t FROM q) SELECT qid, array_to_string({distinct('t')}, ' ') AS terms FROM t",
    "hygiene_flags": f"WITH {LINES} SELECT doc_id, pos, {caption('text')} AS caption, {bullets('text')} AS bullets, {table_header('text')} AS table_header, {heading('text')} AS heading, {incomplete('text')} AS incomplete, md5({dedupe('text')}) AS dedupe FROM lines",
    "noise_clean": f"WITH {LINES} SELECT doc_id, pos, {noise('text')} AS noise, regexp_matches({strip('text')}, '^\\p{{Nd}}{{1,3}}$') AS page_number, round({alpha('text')}, 4) AS alpha FROM lines",
    "evidence_norm": f"SELECT doc_id, md5({evidence('text')}) AS evidence, md5({WS}) AS ws, {n_tokens('text')}::INT AS n_tokens, len({words('text')})::INT AS n_words FROM documents",
    "id_parsers": f"WITH {NODES} SELECT node_id, {_SECTION.format('node_id')} AS section, regexp_replace(node_id, '^(.*)\\.(\\d+)\\.(\\d+)$', '\\1') AS doc, node_id AS name, ('0x' || substr(sha256(node_id), 1, 8))::BIGINT AS seed FROM nodes",
    "bm25_stats": f"WITH d AS (SELECT doc_id, {tokens('text')} AS t FROM documents), n AS (SELECT count(*) AS n FROM d WHERE len(t) > 0), f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM d) GROUP BY 1) SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 4) AS idf FROM f, n",
    "bm25_corpus": f"WITH d AS (SELECT len({tokens('text')}) AS dl FROM documents) SELECT count(*) AS n_docs, round(avg(dl), 4) AS avgdl FROM d WHERE dl > 0",
    "bm25_topk": f"WITH {P}, {Q}, {bm25()} SELECT qid, id, round(score, 4) AS score, rank FROM hits",
    "bm25_rare_terms": f"WITH {P}, {Q}, {bm25()}, {RARE} SELECT qid, array_to_string(must, ' ') AS must FROM must",
    "bm25_heuristic": f"WITH {P}, {Q}, {BM25H} SELECT qid, id, round(score, 4) AS score, r AS rank FROM chosen",
    "dense_topk": f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, {cosine('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT qid, id, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s QUALIFY rank <= 10",
    "dense_label_metrics": f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, a.label = b.label AS same, {cosine('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s QUALIFY rank <= 10) SELECT qid, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 4) AS precision FROM t GROUP BY 1",
    "dense_text_topk": f"WITH {P}, {Q}, {DENSE_TEXT} SELECT qid, id, round(score, 4) AS score, rank FROM dh WHERE rank <= 10",
    "dense_heuristic": f"WITH {P}, {Q}, {DENSE_TEXT}, cand AS (SELECT qid, id, score, rank, {strip('text')} AS t, {dedupe('text')} AS key FROM dh JOIN p USING (id)), {relaxed('cand', [f'{_CLEAN} AND NOT {bullets("t")} AND NOT {incomplete("t")} AND NOT ends_with(t, ' + chr(39) + ':' + chr(39) + ') AND length(t) >= 80', 'false', f'{_CLEAN} AND length(t) >= 40'], 0)} SELECT qid, id, round(score, 4) AS score, r AS rank FROM chosen",
    "graph_nodes": f"WITH {NODES} SELECT node_id, section_id, node_type, doc_id, pos FROM nodes",
    "graph_edges": f"WITH {EDGES} SELECT * FROM edges",
    "section_local_text": f"WITH {SECTIONS} SELECT section_id, level, parent_id, child_pos::INT AS child_pos, length(local_text)::INT AS n, md5(local_text) AS digest FROM sections",
    "section_subtree_text": f"WITH {SUBTREE} SELECT section_id, length(subtree_text)::INT AS n, md5(subtree_text) AS digest FROM sub",
    "section_path": f"WITH {SECTIONS} SELECT a.section_id, array_to_string(list_filter([b.parent_id, a.parent_id, a.section_id], lambda x: x IS NOT NULL), ' > ') AS path FROM sections a LEFT JOIN sections b ON b.section_id = a.parent_id",
    "relation_histogram": f"WITH {EDGES} SELECT rel, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY 1",
    "drill_roots": f"WITH {SCORES} SELECT qid, section_id, round(subtree, 4) AS subtree, rank FROM roots",
    "drill_seeds_absolute": drill("absolute"),
    "drill_seeds_percentile": drill("percentile"),
    "drill_seeds_rank": drill("rank"),
    "bfs_expand": f"WITH {bfs()} SELECT * FROM bfs",
    "bfs_relations": f"WITH {bfs(chr(32) + 'WHERE rel IN (' + repr('HAS_SUBSECTION') + ', ' + repr('LINKS_TO') + ')')} SELECT * FROM bfs",
    "node_score_full": f"WITH {node_scores()} SELECT qid, node_id, section_id, node_type, round(score, 4) AS score, rank FROM top",
    "node_score_text_only": f"WITH {node_scores(False)} SELECT qid, node_id, section_id, node_type, round(score, 4) AS score, rank FROM top",
    "section_candidates": f"WITH {node_scores()}, o AS (SELECT qid, section_id, max(score) AS score, string_agg(node_id, ',' ORDER BY rank) AS nodes FROM top GROUP BY 1, 2) SELECT qid, section_id, round(score, 4) AS score, nodes, string_split(local_text, chr(10))[1] AS title, md5(local_text) AS digest FROM o JOIN loc USING (section_id)",
    "window_spans": f"{_WR} SELECT qid, section_id, node_id, lo, hi FROM sp",
    "window_merge": f"{_WR} SELECT qid, section_id || '::' || members[1] || '..' || members[-1] AS window_id, section_id, rank, round(score, 4) AS score, array_to_string(anchors, ',') AS anchors, array_to_string(members, ',') AS members, lo = 0 AS from_start, md5(text) AS digest FROM wr",
    "windows_flat_doc": f"{_WR}, f AS (SELECT qid, rank, unnest(members) AS node_id, unnest(range(len(members))) AS pos FROM wr), m AS (SELECT qid, node_id, min(rank * 100000 + pos) AS k FROM f GROUP BY 1, 2) SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY k) AS rank FROM m",
    "windows_flat_anchors": f"{_WR}, f AS (SELECT qid, 0 AS part, rank, unnest(anchors) AS node_id, unnest(range(len(anchors))) AS pos FROM wr UNION ALL SELECT qid, 1, rank, unnest(members), unnest(range(len(members))) FROM wr), m AS (SELECT qid, node_id, min(part * 100000000000 + rank * 100000 + pos) AS k FROM f GROUP BY 1, 2) SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY k) AS rank FROM m",
    "first_stage_docs": f"WITH {P}, {Q}, {bm25(k=50)} SELECT qid, id AS doc_id, rank AS doc_rank FROM hits WHERE rank <= 5",
    "hybrid_chunks": f"WITH {node_scores(k=10, reach=f'{EDGES}, {P}, {Q}, {bm25(k=50)}, bfs AS (SELECT qid, node_id AS node, 0 AS dist FROM hits JOIN nodes ON doc_id = id WHERE rank <= 5)')} SELECT qid, node_id, section_id, node_type, round(score, 4) AS score, rank FROM top",
    "gold_exact": f"WITH {NODES} SELECT DISTINCT a.node_id AS qid, b.node_id AS id FROM nodes a JOIN nodes b ON {evidence('a.text')} = {evidence('b.text')} WHERE a.doc_id % 20 = 0 AND {evidence('a.text')} <> ''",
    "gold_containment": f"WITH {P}, {Q}, {GOLD} SELECT qid, id FROM gold",
    "gold_lines": f"WITH {NODES}, {P}, {Q}, {GOLD}, {GOLD_LINES} SELECT qid, id FROM gl",
    "recall_mrr_ndcg_strict": f"WITH {P}, {Q}, {GOLD}, {bm25()}, {metrics('hits', 'gold')} SELECT {_MET}, retrieved FROM met",
    "recall_mrr_ndcg_section": f"WITH {NODES}, {P}, {Q}, {GOLD}, {GOLD_LINES}, np AS (SELECT node_id AS id, text FROM nodes), {bm25('np')}, {metrics('hits', 'gl', _SECTION)} SELECT {_MET}, retrieved FROM met",
    "metrics_macro": f"WITH {P}, {Q}, {GOLD}, {bm25()}, {metrics('hits', 'gold')} SELECT count(*) AS queries, round(avg(recall_5), 4) AS recall_5, round(avg(recall_10), 4) AS recall_10, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(noise), 4) AS noise, round(avg(retrieved), 4) AS retrieved FROM met",
    "window_metrics": f"""{_WR}, {GOLD}, {GOLD_LINES}, g AS (SELECT qid, list(DISTINCT id) AS g FROM gl GROUP BY 1),
w AS (SELECT g.qid, g, wr.rank, coalesce(members, []) AS members, coalesce(list_has_any(members, g), false) AS hit FROM g LEFT JOIN wr USING (qid))
SELECT qid, round(len(list_intersect(coalesce(flatten(list(members) FILTER (rank <= 5)), []), first(g)))::DOUBLE / first(len(g)), 4) AS recall_5, round(len(list_intersect(coalesce(flatten(list(members) FILTER (rank <= 10)), []), first(g)))::DOUBLE / first(len(g)), 4) AS recall_10,
round(coalesce(1 / min(rank) FILTER (hit), 0), 4) AS mrr, round(coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 10) / {ideal('least(first(len(g)), 10)')}, 0), 4) AS ndcg, round(coalesce(avg(CASE WHEN hit THEN 0.0 ELSE 1.0 END) FILTER (rank <= 10), 0), 4) AS noise FROM w GROUP BY qid""",
    "diag_novelty": f"WITH {P}, {Q}, {GOLD}, {bm25()}, {metrics('hits', 'gold')} SELECT {_MET}, retrieved FROM met",
    "run_overlap": f"WITH {RUNS}, t AS (SELECT method AS run, qid, list(id) AS ids FROM runs GROUP BY 1, 2), o AS (SELECT a.run AS run_a, b.run AS run_b, len(list_intersect(a.ids, b.ids)) / 10 AS o, len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids))) AS j FROM t a JOIN t b ON a.qid = b.qid AND a.run < b.run) SELECT run_a, run_b, count(*) AS queries, round(avg(o), 4) AS overlap_mean, round(median(o), 4) AS overlap_median, round(avg(j), 4) AS jaccard_mean, round(median(j), 4) AS jaccard_median FROM o GROUP BY 1, 2",
    "budget_unify": f"{PACKED} SELECT method, qid, id, rank::INT AS rank, tokens::INT AS tokens FROM pk",
    "token_stats": f"{PACKED}, t AS (SELECT method, qid, sum(tokens)::BIGINT AS t FROM pk GROUP BY 1, 2) SELECT method, count(*) AS queries, round(avg(t), 4) AS mean, round(median(t), 4) AS median, min(t) AS least, max(t) AS most, round(avg(CASE WHEN t >= 1600 THEN 1.0 ELSE 0.0 END), 4) AS near_budget FROM t GROUP BY 1",
    "pack_summary": f"{PACKED}, g AS (SELECT method, qid, count(*) AS g FROM runs GROUP BY 1, 2), n AS (SELECT method, qid, count(*) AS n, sum(tokens) AS t FROM pk GROUP BY 1, 2), r AS (SELECT method, qid, g, coalesce(n, 0) AS n, coalesce(t, 0) AS t FROM g LEFT JOIN n USING (method, qid)) SELECT method, count(*) AS queries, round(avg(n), 4) AS avg_items, round(avg(g - n), 4) AS avg_truncated, round(avg(t), 4) AS avg_tokens FROM r GROUP BY 1",
    "pairs": f"WITH {RUNS}, {SIMPLE.removeprefix(Q + ', ')}, c AS (SELECT method, qid, string_agg(id::VARCHAR, ',' ORDER BY rank) AS c FROM runs GROUP BY 1, 2) SELECT pair_id, comparison_id, pr.qid, perm, CASE WHEN perm = 'AB' THEN first ELSE second END AS method_a, CASE WHEN perm = 'AB' THEN second ELSE first END AS method_b, CASE WHEN perm = 'AB' THEN a.c ELSE b.c END AS context_a, CASE WHEN perm = 'AB' THEN b.c ELSE a.c END AS context_b FROM pr JOIN c a ON a.method = first AND a.qid = pr.qid JOIN c b ON b.method = second AND b.qid = pr.qid",
    "vote_outcome": f"WITH {DECISIONS} SELECT * FROM ou",
    "win_rates": f"WITH {DECISIONS}, r AS (SELECT comparison_id, axis, avg((outcome = 'first')::INT) AS win_a, avg((outcome = 'tie')::INT) AS tie, avg((outcome = 'second')::INT) AS win_b, count(*) AS n_queries FROM ou GROUP BY 1, 2), a AS (SELECT * FROM r UNION ALL SELECT comparison_id, 'overall', avg(win_a), avg(tie), avg(win_b), max(n_queries) FROM r GROUP BY 1) SELECT comparison_id, axis, round(win_a, 4) AS win_a, round(tie, 4) AS tie, round(win_b, 4) AS win_b, n_queries FROM a",
    "inter_judge": f"WITH {DECISIONS}, c AS (SELECT pair_id, axis, count(*) AS n, count(DISTINCT label) AS d FROM la GROUP BY 1, 2 HAVING n = 3) SELECT axis, count(*) FILTER (d = 1) AS all_agree, count(*) AS total, round(count(*) FILTER (d = 1) / count(*), 4) AS rate FROM c GROUP BY 1",
    "perm_consistency": f"WITH {DECISIONS}, c AS (SELECT judge, axis, comparison_id, qid, max(label) FILTER (perm = 'AB') AS ab, max(label) FILTER (perm = 'BA') AS ba FROM la GROUP BY 1, 2, 3, 4) SELECT judge, axis, count(*) FILTER (ba = CASE ab WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE ab END) AS consistent, count(*) AS total, round(count(*) FILTER (ba = CASE ab WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE ab END) / count(*), 4) AS rate FROM c WHERE ab IS NOT NULL AND ba IS NOT NULL GROUP BY 1, 2",
    "operational_rollup": f"WITH {DECISIONS}, pc AS (SELECT * FROM (VALUES ('j1', 0.25, 1.25), ('j2', 0.5, 1.5), ('j3', 1.0, 3.0)) t(judge, i, o)) SELECT coalesce(judge, 'TOTAL') AS judge, count(*) AS calls, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed, count(*) FILTER (h % 3 + 1 > 1) AS retries, sum(h % 900)::BIGINT AS input_tokens, sum(h % 70)::BIGINT AS output_tokens, sum(h % 900 + h % 70)::BIGINT AS total_tokens, sum(h % 4000)::BIGINT AS latency_ms, round(sum((h % 900) * i::DOUBLE / 1e6 + (h % 70) * o::DOUBLE / 1e6), 4) AS cost FROM de JOIN pc USING (judge) GROUP BY ROLLUP (judge)",
    "calibration": f"WITH {DECISIONS}, r AS (SELECT judge, axis, count(*) AS n, avg((label = manual)::INT) AS d, avg((CASE label WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE label END = manual)::INT) AS v FROM la JOIN mn USING (pair_id, axis) GROUP BY 1, 2) SELECT judge, axis, n, round(d, 4) AS direct, round(v, 4) AS inverted, v > d AND d < 0.5 AS suspicious FROM r",
    "confusion": f"WITH {DECISIONS} SELECT axis, manual, label, count(*) AS n FROM la JOIN mn USING (pair_id, axis) GROUP BY 1, 2, 3",
    "fiveway_summary": f"WITH {CHOICES} SELECT method, 'overall' AS metric, count(*) AS n, round(avg(score), 4) AS mean, round(coalesce(stddev_samp(score), 0), 4) AS std FROM ch GROUP BY 1",
    "fiveway_consensus": f"WITH {CHOICES}, r AS (SELECT *, sum(v) OVER (PARTITION BY qid) AS n, coalesce(lead(v) OVER (PARTITION BY qid ORDER BY v DESC, method), 0) AS next, row_number() OVER (PARTITION BY qid ORDER BY v DESC, method) AS r FROM cc) SELECT qid, CASE WHEN v * 2 > n AND v > next THEN method ELSE '__TIE_OR_EMPTY__' END AS winner, v AS votes, n::BIGINT AS n FROM r WHERE r = 1",
    "fiveway_distribution": f"WITH {CHOICES} SELECT qid, string_agg(method || ':' || v || ';', '' ORDER BY v DESC, method) AS breakdown FROM cc GROUP BY 1",
    "pairwise_with_skips": f"WITH {RUNS}, {CHOICES.removeprefix(Q + ', ')}, cq AS (SELECT method, qid, string_agg(id::VARCHAR, ',' ORDER BY rank) AS c FROM runs GROUP BY 1, 2), same AS (SELECT a.qid FROM cq a JOIN cq b ON a.qid = b.qid AND a.c = b.c WHERE a.method = 'bm25' AND b.method = 'bm25_heuristic'), v AS (SELECT qid, method, count(*) AS v FROM ch WHERE method <> '' AND qid NOT IN (SELECT qid FROM same) GROUP BY 1, 2), t AS (SELECT *, v / sum(v) OVER (PARTITION BY qid) AS share, row_number() OVER (PARTITION BY qid ORDER BY v DESC, method) AS r FROM v) SELECT q.qid, coalesce(method, '__SKIPPED_IDENTICAL__') AS decision, round(coalesce(share, 1), 4) AS share FROM q LEFT JOIN t ON t.qid = q.qid AND r = 1",
    "integrity": f"WITH {CHOICES}, m AS (SELECT DISTINCT method, qid FROM ch WHERE method <> ''), t AS (SELECT count(DISTINCT qid) AS t FROM m) SELECT method, count(*) AS qids, t - count(*) AS missing, count(*) = t AND t = 40 AS complete FROM m, t GROUP BY method, t",
    "coverage_filters": "WITH m AS (SELECT c_nationkey AS pmid, arg_min(c_mktsegment, c_custkey) AS pmcid FROM customer GROUP BY 1), r AS (SELECT c_mktsegment AS qid, count(DISTINCT c_nationkey) AS n_pmids, count(DISTINCT pmcid) AS n_pmcs FROM customer JOIN m ON c_nationkey = pmid GROUP BY 1) SELECT qid, n_pmids, n_pmcs, round(n_pmcs / n_pmids, 4) AS ratio, n_pmcs >= 1 AS lenient, n_pmcs >= 2 OR n_pmcs / n_pmids >= 0.5 AS strict FROM r",
    "latest_decision": "SELECT event_type AS judge, user_id AS pair_id, max(event_id) AS seq, round(arg_max(value, event_id), 4) AS value FROM events GROUP BY 1, 2",
    "status_counters": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "region_tree_paths": "WITH s AS (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) SELECT c_custkey, r_name || ' > ' || n_name || ' > ' || c_name AS path, coalesce(orders, 0) AS orders, coalesce(total, 0) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN s ON o_custkey = c_custkey",
    "conversation_turns": f"SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, {n_tokens('text')}::INT AS n_tokens FROM conversations",
    "walk_query": f"{WALK} SELECT qid, node_id, section_id, node_type, round(score, 4) AS score, rank FROM top",
    "walk_sections": f"{WALK}, o AS (SELECT qid, section_id, max(round(score, 6)) AS score, string_agg(node_id, ',' ORDER BY rank) AS nodes FROM top GROUP BY 1, 2) SELECT qid, section_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, section_id) AS rank, round(score, 4) AS score, nodes, string_split(local_text, chr(10))[1] AS title, md5(local_text) AS digest FROM o JOIN loc USING (section_id)",
    "walk_windows": f"{WALK}{WINDOW_TAIL} SELECT qid, wr.section_id || '::' || members[1] || '..' || members[-1] AS chunk_id, wr.section_id, parent_id AS parent_section_id, rank, round(score, 4) AS score, array_to_string(anchors, ',') AS anchors, array_to_string(members, ',') AS members, lo = 0 AS from_start, md5(text) AS digest FROM wr JOIN sections USING (section_id)",
    "walk_graph": f"{WALK} SELECT qid, src, dst, rel, dist + 1 AS dist FROM bfs JOIN e ON node = src WHERE dist < 3",
    "walk_debug": f"""{WALK}, eg AS (SELECT qid, rel FROM bfs JOIN e ON node = src WHERE dist < 3), a AS (SELECT qid, count(*) AS seeds FROM sd GROUP BY 1), b AS (SELECT qid, count(*) AS nodes, max(dist) AS max_dist FROM bfs GROUP BY 1), c AS (SELECT qid, count(*) AS edges FROM eg GROUP BY 1),
t AS (SELECT qid, count(*) AS ranked, min(score) AS score_min, max(score) AS score_max, avg(score) AS score_mean FROM top GROUP BY 1), y AS (SELECT qid, string_agg(node_type || ':' || n, ',' ORDER BY node_type) AS types FROM (SELECT qid, node_type, count(*) AS n FROM top GROUP BY 1, 2) GROUP BY 1), z AS (SELECT qid, string_agg(rel || ':' || n, ',' ORDER BY rel) AS relations FROM (SELECT qid, rel, count(*) AS n FROM eg GROUP BY 1, 2) GROUP BY 1)
SELECT qid, seeds, nodes, max_dist, coalesce(edges, 0) AS edges, coalesce(ranked, 0) AS ranked, round(score_min, 4) AS score_min, round(score_max, 4) AS score_max, round(score_mean, 4) AS score_mean, coalesce(types, '') AS types, coalesce(relations, '') AS relations FROM a LEFT JOIN b USING (qid) LEFT JOIN c USING (qid) LEFT JOIN t USING (qid) LEFT JOIN y USING (qid) LEFT JOIN z USING (qid)""",
    "document_map": f"WITH {SECTIONS} SELECT section_id AS id, doc_id::VARCHAR AS doc_id FROM sections UNION ALL SELECT node_id, doc_id::VARCHAR FROM nodes",
    "restricted_edges": f"WITH {EDGES}, {Q}, {_DOCS}, al AS (SELECT qid, section_id AS node FROM docs JOIN sections ON doc_id = id UNION ALL SELECT qid, node_id FROM docs JOIN nodes ON doc_id = id) SELECT a.qid, src, dst, rel, edge_pos FROM edges JOIN al a ON a.node = src JOIN al b ON b.node = dst AND a.qid = b.qid",
    "hybrid_walk": f"{HYBRID} SELECT qid, node_id, section_id, node_type, round(score, 4) AS score, rank FROM top",
    "hybrid_windows": f"{HYBRID}{WINDOW_TAIL} SELECT qid, section_id || '::' || members[1] || '..' || members[-1] AS window_id, rank, round(score, 4) AS score, array_to_string(members, ',') AS members FROM wr",
    "bfs_capped": f"WITH {capped()} SELECT * FROM n3",
    "diag_criteria": f"WITH {NODES}, {P}, {Q}, {GOLD}, {CONTEXTS}, " + ", ".join(criterion(n, str(i)) for i, n in enumerate(_GU)) + " " + " UNION ALL ".join(f"SELECT '{n}' AS criterion, count(*) AS queries, round(avg(recall_5), 4) AS recall_5, round(avg(recall_10), 4) AS recall_10, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(noise), 4) AS noise, round(avg(retrieved), 4) AS retrieved FROM met{i}" for i, n in enumerate(_GU)),
    "diag_false_negatives": f"WITH {NODES}, {P}, {Q}, {GOLD}, {CONTEXTS}, {criterion('strict_chunk', 'a')}, {criterion('same_section', 'b')}, {criterion('text_overlap_30', 'c')} SELECT qid, round(meta.recall_10, 4) AS strict, round(metb.recall_10, 4) AS same_section, round(metc.recall_10, 4) AS overlap FROM meta JOIN metb USING (qid) JOIN metc USING (qid) WHERE meta.recall_10 = 0 AND (metb.recall_10 > 0 OR metc.recall_10 > 0)",
    "restricted_queries": f"WITH {P}, {Q}, {GOLD} SELECT qid, md5(query) AS digest FROM q WHERE qid IN (SELECT qid FROM gold)",
    "missing_predictions": f"WITH {P}, {Q}, {BM25H}, g AS (SELECT qid, string_agg(id::VARCHAR, ',' ORDER BY r) AS ids FROM chosen GROUP BY 1) SELECT qid, coalesce(ids, '') AS ids, ids IS NULL AS missing FROM q LEFT JOIN g USING (qid)",
    "gold_lists": f"WITH {NODES}, {P}, {Q}, {GOLD}, {GOLD_LINES} SELECT qid, array_to_string(list_sort(list(DISTINCT gl.id)), ',') AS ids, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS docs FROM gl JOIN nodes ON node_id = gl.id GROUP BY 1",
    "gold_unmapped": f"""WITH {NODES}, c AS (SELECT doc_id, pos, node_id, text, {evidence('text')} AS t FROM nodes WHERE doc_id % 20 = 0), e AS (SELECT doc_id, pos, t AS n FROM c WHERE NOT starts_with(upper(text), '{'FLOAT SELECTED:'}') AND t <> ''),
m AS (SELECT e.doc_id, e.pos, c.node_id, c.pos AS cp FROM e JOIN c ON e.doc_id = c.doc_id AND e.n = c.t), f AS (SELECT doc_id, node_id, min((pos, cp)) AS k FROM m GROUP BY 1, 2), g AS (SELECT doc_id, string_agg(node_id, ',' ORDER BY k) AS ids FROM f GROUP BY 1),
u AS (SELECT doc_id, count(*) AS u FROM c WHERE starts_with(upper(text), '{'FLOAT SELECTED:'}') GROUP BY 1) SELECT DISTINCT c.doc_id AS qid, coalesce(ids, '') AS ids, coalesce(u, 0)::INT AS unmapped FROM c LEFT JOIN g USING (doc_id) LEFT JOIN u USING (doc_id)""",
    "type_changes": f"WITH {NODES} SELECT node_type AS type, count(*) AS before, count(*) FILTER (NOT {noise('text')}) AS after, count(*) FILTER ({noise('text')}) AS removed FROM nodes GROUP BY 1",
    "truncation_share": f"WITH {SUBTREE}, s AS (SELECT section_id, subtree_text FROM sub JOIN sections USING (section_id) WHERE level > 0 ORDER BY md5(section_id), section_id LIMIT 2500), c AS (SELECT count(*) AS sampled, count(*) FILTER ({n_tokens('subtree_text')} > 100) AS truncated FROM s) SELECT sampled, truncated, round(CASE WHEN sampled > 0 THEN truncated / sampled ELSE 0 END, 4) AS share FROM c",
    "chunk_windows_1200": f"""WITH t AS (SELECT doc_id, {strip("regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')")} AS t FROM documents), k AS (SELECT doc_id, t, greatest(0, ceil((length(t) - 1200) / 1000))::INT AS last, unnest(range(0, greatest(0, ceil((length(t) - 1200) / 1000))::INT + 1)) AS k FROM t),
w AS (SELECT doc_id, k, last, substr(t, k * 1000 + 1, 1200) AS w FROM k), x AS (SELECT *, length(regexp_replace(w, ' [^ ]*$', '')) AS c FROM w),
p AS (SELECT doc_id, k, trim(CASE WHEN k < last AND c < length(w) AND c > 400 THEN left(w, c) ELSE w END) AS text FROM x) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, text FROM p WHERE text <> ''""",
    "id_names": f"WITH {NODES} SELECT node_id, 'D' || doc_id AS chunk_doc, regexp_replace(section_id, '\\.[0-9]+$', '') AS section_doc, pos::BIGINT AS number, node_id AS second FROM nodes",
    "snippet_match": f"""WITH {NODES}, {P}, {Q}, {bm25()}, sl AS (SELECT qid, unnest(range(len(l)))::INT AS snippet_id, unnest(l) AS snippet FROM (SELECT qid, string_split(query, chr(10)) AS l FROM q)),
sn AS (SELECT s.qid, snippet_id, snippet, h.id AS doc, {snippet('snippet')} AS n FROM sl s LEFT JOIN hits h ON h.qid = s.qid AND h.rank = 1 WHERE {strip('snippet')} <> ''),
sp AS (SELECT qid, snippet_id, n, node_id AS id, {snippet('nodes.text')} AS t, nodes.doc_id IS NULL AS none, CASE WHEN len({words('snippet')}) = 0 THEN 0 ELSE len(list_intersect({words('nodes.text')}, {words('snippet')}))::DOUBLE / len({words('snippet')}) END AS o FROM sn LEFT JOIN nodes ON nodes.doc_id = sn.doc),
sk AS (SELECT *, CASE WHEN none THEN 'no_document' WHEN n <> '' AND t <> '' AND (contains(t, n) OR contains(n, t)) THEN 'substring' WHEN o >= 0.6 THEN 'token_overlap' ELSE 'no_chunk_match' END AS kind FROM sp),
sc AS (SELECT *, CASE kind WHEN 'substring' THEN least(length(n), length(t)) / greatest(length(n), length(t)) WHEN 'token_overlap' THEN o END AS score FROM sk)
SELECT qid, snippet_id, CASE WHEN score IS NOT NULL THEN id END AS id, round(score, 4) AS score, kind FROM sc QUALIFY row_number() OVER (PARTITION BY qid, snippet_id ORDER BY CASE kind WHEN 'substring' THEN 0 WHEN 'token_overlap' THEN 1 ELSE 2 END, score DESC NULLS LAST, length(t), id) = 1""",
    "judge_payloads": f"WITH {FIVE} SELECT qid, string_agg(letter || '=' || method, ',' ORDER BY letter) AS mapping, string_agg(letter || '=' || context, ',' ORDER BY letter) AS contexts FROM fl GROUP BY 1",
    "judge_prompts": f"WITH {FIVE}, b AS (SELECT qid, string_agg('CANDIDATE ' || letter || ':' || chr(10) || context, chr(10) || chr(10) ORDER BY letter) AS b FROM fl GROUP BY 1) SELECT qid, 'multiway' AS mode, CASE WHEN contains(query, 'coherence') THEN 'fiveway_reasoning' ELSE 'fiveway' END AS schema, md5('## SYSTEM' || chr(10) || chr(10) || 'Compare the candidates.' || chr(10) || chr(10) || '## USER' || chr(10) || chr(10) || 'QUERY:' || chr(10) || {strip('query')} || chr(10) || chr(10) || b) AS digest FROM b JOIN q USING (qid)",
    "report_long": f"WITH {FIVE_RUNS} SELECT qid, judge AS model, letter, method, ok AS parse_ok, ok AND fail AS is_failure, " + ", ".join(f"CASE WHEN ok THEN {m} END AS {m}" for m in METRICS) + ", CASE WHEN ok THEN 'because ' || letter || ' ' || judge ELSE '' END AS rationale FROM rl",
    "report_wide": f"WITH {FIVE_RUNS} SELECT qid, judge AS model, 'fiveway' AS mode, ok AS parse_ok, CASE WHEN NOT ok THEN 'status=ERROR' END AS parse_error, CASE WHEN ok THEN winner ELSE '' END AS winner_letter, coalesce(max(method) FILTER (ok AND letter = winner), '') AS winner_method, coalesce(string_agg(letter, ',' ORDER BY letter) FILTER (ok AND fail), '') AS failure_letters, coalesce(string_agg(method, ',' ORDER BY letter) FILTER (ok), '') AS ranking_methods, " + ", ".join(f"max({m}) FILTER (ok AND letter = '{k}') AS {m}_{k}" for m in ("overall", "coherence") for k in "ABCDE") + " FROM rl GROUP BY qid, judge, ok, winner",
    "report_consensus": f"WITH {FIVE_RUNS} SELECT qid, letter, method, count(*) AS n_judges, " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in METRICS) + ", count(*) FILTER (fail) * 2 > count(*) AS is_failure, 'because ' || letter || ' ' || arg_min(judge, (-overall, judge)) AS rationale FROM rl WHERE ok GROUP BY 1, 2, 3",
    "report_without_ties": f"WITH {FIVE_RUNS}, r AS (SELECT DISTINCT qid, judge, ok, winner FROM rl) SELECT judge AS model, count(*) FILTER (NOT (ok AND winner = '')) AS runs, count(*) FILTER (ok AND winner <> '') AS ok FROM r GROUP BY 1",
    "report_votes": f"WITH {CHOICES}, r AS (SELECT *, sum(v) OVER (PARTITION BY qid) AS n, coalesce(lead(v) OVER (PARTITION BY qid ORDER BY v DESC, method), 0) AS next, row_number() OVER (PARTITION BY qid ORDER BY v DESC, method) AS r FROM cc), b AS (SELECT qid, string_agg(method || ':' || v, ';' ORDER BY v DESC, method) AS breakdown FROM cc GROUP BY 1) SELECT qid, n::BIGINT AS n_runs, CASE WHEN v * 2 > n AND v > next AND method <> '__TIE_OR_EMPTY__' THEN method ELSE '' END AS winner, v AS votes, round(v / n, 4) AS share, breakdown, v * 2 > n AND v > next AND method <> '__TIE_OR_EMPTY__' AS has_majority FROM r JOIN b USING (qid) WHERE r = 1",
    "answers_checked": "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN chr(39) || 'decision' || chr(39) || ' must be empty, A or B' WHEN event_id % 3 = 0 THEN chr(39) || 'reason' || chr(39) || ' must be a text' END AS pairwise, 'Missing keys:' AS fiveway, CASE WHEN event_id % 4 <> 3 AND event_id % 3 <> 0 THEN ['A', 'B', ''][event_id % 4 + 1] END AS salvaged FROM events",
    "counterparts": f"WITH {SIMPLE} SELECT a.pair_id, b.pair_id AS other_id FROM pr a JOIN pr b ON a.comparison_id = b.comparison_id AND a.qid = b.qid AND a.perm <> b.perm",
    "worth_judging": f"WITH {RUNS}, {SIMPLE.removeprefix(Q + ', ')}, c AS (SELECT method, qid, string_agg(id::VARCHAR, ',' ORDER BY rank) AS c FROM runs GROUP BY 1, 2) SELECT pair_id FROM pr JOIN c a ON a.method = first AND a.qid = pr.qid JOIN c b ON b.method = second AND b.qid = pr.qid WHERE a.c <> b.c",
    "pairs_complete": f"WITH {SIMPLE} SELECT comparison_id, count(*) AS pairs, 0::BIGINT AS missing_orders, (SELECT count(*) FROM pr) AS total, true AS complete FROM pr GROUP BY 1",
    "majority_expert": f"WITH {DECISIONS}, x AS (SELECT comparison_id, qid, axis, CASE manual WHEN 'A' THEN 'first' WHEN 'B' THEN 'second' ELSE 'equal' END AS e FROM mn JOIN pr USING (pair_id) WHERE perm = 'AB'), y AS (SELECT axis, e, CASE outcome WHEN 'tie' THEN 'equal' ELSE outcome END AS o FROM ou JOIN x USING (comparison_id, qid, axis) WHERE n >= 4) SELECT axis, count(*) AS n, count(*) FILTER (o = e) AS agree, round(count(*) FILTER (o = e) / count(*), 4) AS rate FROM y GROUP BY 1",
    "in_every_method": f"WITH {CHOICES}, m AS (SELECT DISTINCT method, qid FROM ch WHERE method <> '') SELECT qid FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT method) FROM m)",
    "turn_counts": "SELECT conv_id::VARCHAR AS qid, arg_min(role, turn) AS type, array_to_string(list_sort(list(DISTINCT turn::VARCHAR)), ',') AS ids, count(DISTINCT turn)::INT AS n FROM conversations GROUP BY 1",
}
