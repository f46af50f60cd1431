"""SQL for DuckDB that gives the same rows as the catalogue's queries.

The statements are put together from a few common table expressions: redacted documents, chunks, tokens, sources, pairs.
"""

from __future__ import annotations

from ..functions import lexicon, porter, text
from . import catalogue

AS_OF = "TIMESTAMP '2024-03-15 00:00:00'"
DAY0 = "TIMESTAMP '2024-01-01 00:00:00'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words_in(words) -> str:
    return "(" + ", ".join(q(w) for w in sorted(words)) + ")"


def sha(x: str) -> str:
    return f"sha256({x})"


def byte_prefix(x: str, n: int) -> str:
    return f"substr({x}, 1, coalesce(list_max(list_filter(range(0, {n + 1}), lambda i: strlen(substr({x}, 1, i)) <= {n})), 0))"


def _redacted(x: str) -> str:
    out = f"regexp_replace({x}, {q(lexicon.PRIVATE_BLOCK)}, {q(lexicon.PRIVATE_MARK)}, 'g')"
    for p in lexicon.SECRET_PATTERNS:
        out = f"regexp_replace({out}, {q(p)}, {q(lexicon.SECRET_MARK)}, 'g')"
    return out


RED = f"red AS MATERIALIZED (SELECT doc_id AS source_id, {_redacted('text')} AS text FROM documents)"
CHUNKS = rf"""{RED},
ls AS (SELECT source_id, text, string_split(text, chr(10)) AS l, regexp_split_to_array(text, '\n[\t\n\f\r ]*\n') AS sec FROM red),
shape AS (SELECT *, len(l) AS n, len(sec) BETWEEN 3 AND 200 AND list_max(list_transform(sec, lambda s: strlen(s))) <= 5000 AS few FROM ls),
raw AS (
  SELECT source_id, 0 AS i, {trim("text")} AS content, 'Output' AS title FROM shape WHERE n <= 20
  UNION ALL SELECT source_id, i, {trim("sec[i + 1]")}, 'Section ' || (i + 1) FROM shape, unnest(range(0, len(sec))) AS r(i) WHERE n > 20 AND few
  UNION ALL SELECT source_id, i, {trim("array_to_string(l[i * 18 + 1:i * 18 + 20], chr(10))")}, 'Lines ' || (i * 18 + 1) || '-' || least(i * 18 + 20, n)
  FROM shape, unnest(range(0, CAST(ceil((n - 20) / 18.0) AS BIGINT) + 1)) AS r(i) WHERE n > 20 AND NOT few),
firsts AS (SELECT *, {trim("split_part(content, chr(10), 1)")} AS f FROM raw WHERE content <> '' OR title = 'Output'),
chunks AS MATERIALIZED (SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY i) - 1 AS INTEGER) AS chunk_no,
  source_id * 1048576 + row_number() OVER (PARTITION BY source_id ORDER BY i) - 1 AS chunk_id,
  CASE WHEN title = 'Output' OR f = '' THEN title ELSE {byte_prefix("f", 80)} END AS title, content FROM firsts)"""
VOCAB = f"""{CHUNKS},
vw AS MATERIALIZED (SELECT source_id, chunk_no, chunk_id, no, w[no + 1] AS word FROM (SELECT source_id, chunk_no, chunk_id,
  list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_-]+'), lambda x: strlen(x) >= 3 AND x NOT IN {words_in(lexicon.STOPWORDS)}) AS w FROM chunks) t, unnest(range(0, len(w))) AS r(no))"""


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(translate(lower({x}), {q(text._MARKED)}, {q(text._PLAIN)}), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


TOKENS = f"""{CHUNKS}, tk AS MATERIALIZED (SELECT chunk_id, source_id, title, {_tokens("title")} AS tt, {_tokens("content")} AS ct FROM chunks),
lens AS (SELECT chunk_id, len(tt) + len(ct) AS dl FROM tk), corpus AS (SELECT count(*) AS n, avg(dl) AS mean FROM lens)"""


def _terms(queries, expand: bool = False, trigram: bool = False) -> str:
    """VALUES of query_id, group_no, term, as the query compiler has them."""
    rows = []
    for query_id, raw in queries:
        for c in "'\"(){}[]*:^~":
            raw = raw.replace(c, " ")
        words = list(dict.fromkeys(filter(None, (w.strip(".,!?;:").lower() for w in raw.split()))))
        words = [w for w in words if w not in lexicon.STOPWORDS] or words
        for no, w in enumerate(words):
            if w.upper() not in lexicon.QUERY_KEYWORDS:
                rows += [(query_id, no, t) for t in (w, *(lexicon.synonyms(w) if expand else ())) if not trigram or len(t) >= 3]
    return "terms(query_id, group_no, term) AS (VALUES " + ", ".join(f"({a}, {b}, {q(c)})" for a, b, c in rows) + ")"


_KIND = "vcccvcccvcccccvcccccvcccc"  # of a to z without y


def _kinds(w: str) -> str:
    """Vowels and consonants of a word: y is one or the other by what stands before it."""
    out = f"regexp_replace(translate({w}, 'abcdefghijklmnopqrstuvwxz', '{_KIND}'), '^y', 'c')"
    for _ in range(3):
        out = f"replace(replace({out}, 'cy', 'cv'), 'vy', 'vc')"
    return out


def _porter(words: str) -> str:
    """stems(token, stem) of a table of tokens: the published steps, each over the word and its kinds."""
    left = lambda k: f"left(w, length(w) - {k})"
    cut = lambda k: f"left(k, length(w) - {k})"
    m = lambda kinds: f"len(regexp_extract_all({kinds}, 'v+c+'))"
    cvc = lambda w, kinds: f"({kinds} LIKE '%cvc' AND NOT regexp_matches({w}, '[wxy]$'))"
    step = lambda name, of, then: f"{name} AS (SELECT token, {_kinds('w')} AS k, w FROM (SELECT token, {then} AS w FROM {of}) t)"
    rules = lambda table: sorted((r.partition(":")[::2] for r in table.split()), key=lambda r: -len(r[0]))

    def table(rows, least) -> str:
        return "CASE " + " ".join(f"WHEN ends_with(w, '{a}') THEN CASE WHEN {m(cut(len(a)))} > {least} THEN {left(len(a))} || '{b}' ELSE w END" for a, b in rows) + " ELSE w END"

    fours = " ".join(
        f"WHEN ends_with(w, '{a}') THEN CASE WHEN {m(cut(len(a)))} > 1" + (f" AND regexp_matches({left(3)}, '[st]$')" if a == "ion" else "") + f" THEN {left(len(a))} ELSE w END"
        for a in sorted(porter.STEP_4.split(), key=len, reverse=True)
    )
    fix = f"CASE WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN length(w) > 1 AND right(w, 1) = substr(w, length(w) - 1, 1) AND k LIKE '%c' AND NOT regexp_matches(w, '[lsz]$') THEN {left(1)} WHEN {m('k')} = 1 AND {cvc('w', 'k')} THEN w || 'e' ELSE w END"
    stripped = f"CASE WHEN ends_with(w, 'eed') THEN '' WHEN ends_with(w, 'ed') AND contains({cut(2)}, 'v') THEN {left(2)} WHEN ends_with(w, 'ing') AND contains({cut(3)}, 'v') THEN {left(3)} ELSE '' END"
    return ", ".join(
        [
            f"plain_ AS (SELECT token FROM {words} WHERE regexp_full_match(token, '[a-z]{{3,}}'))",
            step("s1a", "plain_", "CASE WHEN regexp_matches(token, '(sses|ies)$') THEN left(token, length(token) - 2) WHEN regexp_matches(token, '[^s]s$') THEN left(token, length(token) - 1) ELSE token END"),
            f"cut_ AS (SELECT token, w0, {_kinds('w')} AS k, w FROM (SELECT token, CASE WHEN ends_with(w, 'eed') AND {m(cut(3))} > 0 THEN {left(1)} ELSE w END AS w0, {stripped} AS w FROM s1a) t)",
            step("s1b", "cut_", f"CASE WHEN w = '' THEN w0 ELSE {fix} END"),
            step("s1c", "s1b", f"CASE WHEN ends_with(w, 'y') AND contains({cut(1)}, 'v') THEN {left(1)} || 'i' ELSE w END"),
            step("s2", "s1c", table(rules(porter.STEP_2), 0)), step("s3", "s2", table(rules(porter.STEP_3), 0)), step("s4", "s3", f"CASE {fours} ELSE w END"),
            step("s5", "s4", f"CASE WHEN ends_with(w, 'e') AND ({m(cut(1))} > 1 OR {m(cut(1))} = 1 AND NOT {cvc(left(1), cut(1))}) THEN {left(1)} ELSE w END"),
            f"stems AS MATERIALIZED (SELECT token, CASE WHEN {m('k')} > 1 AND w LIKE '%ll' THEN {left(1)} ELSE w END AS stem FROM s5 UNION ALL SELECT token, token FROM {words} WHERE NOT regexp_full_match(token, '[a-z]{{3,}}'))",
        ]
    )


_SCORED = """counted AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT h.term, h.chunk_id, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * (2.0 * th + ch) * 2.2
  / ((2.0 * th + ch) + 1.2 * (0.25 + 0.75 * dl / mean)) AS score FROM hits h JOIN counted USING (term) JOIN lens USING (chunk_id), corpus),
sizes AS (SELECT query_id, count(DISTINCT group_no) AS g FROM terms GROUP BY query_id),
layer AS (SELECT query_id, chunk_id, round(sum(score), 9) AS score, count(DISTINCT group_no) AS met FROM terms JOIN scored USING (term) GROUP BY query_id, chunk_id),
ranked AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) - 1 AS INTEGER) AS rank0 FROM layer JOIN sizes USING (query_id) WHERE {where})"""
_STEMMED = f"""every_ AS (SELECT DISTINCT token FROM (SELECT unnest(list_concat(tt, ct)) AS token FROM tk) t UNION SELECT DISTINCT term FROM terms), {_porter("every_")}"""
_WORD_HITS = _STEMMED + """, wanted AS (SELECT DISTINCT term, stem FROM terms JOIN stems ON token = term),
places AS (SELECT chunk_id, 0 AS c, unnest(tt) AS token FROM tk UNION ALL SELECT chunk_id, 1, unnest(ct) FROM tk),
hits AS MATERIALIZED (SELECT term, chunk_id, count(*) FILTER (WHERE c = 0) AS th, count(*) FILTER (WHERE c = 1) AS ch FROM places JOIN stems USING (token) JOIN wanted USING (stem) GROUP BY term, chunk_id)"""
_TRI_HITS = """wanted AS (SELECT DISTINCT term FROM terms),
low AS MATERIALIZED (SELECT chunk_id, lower(title) AS t, lower(content) AS c FROM chunks),
hits AS MATERIALIZED (SELECT term, chunk_id, len(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, length(term)) = term)) AS th,
  CASE WHEN contains(c, term) THEN len(list_filter(range(1, length(c) + 1), lambda i: substr(c, i, length(term)) = term)) ELSE 0 END AS ch FROM low, wanted WHERE contains(c, term) OR contains(t, term))"""
TRI_LENS = f"{CHUNKS}, lens AS (SELECT chunk_id, greatest(0, length(title) - 2) + greatest(0, length(content) - 2) AS dl FROM chunks), corpus AS (SELECT count(*) AS n, avg(dl) AS mean FROM lens)"
_TOP = "SELECT query_id, rank0, chunk_id, round(score, 6) AS score FROM ranked WHERE rank0 < 20"


def _word(where: str, expand: bool = False, queries=catalogue.QUERIES) -> str:
    return f"WITH {TOKENS}, {_terms(queries, expand)}, {_WORD_HITS}, {_SCORED.format(where=where)}"


def _tri(where: str) -> str:
    return f"WITH {TRI_LENS}, {_terms(catalogue.QUERIES, trigram=True)}, {_TRI_HITS}, {_SCORED.format(where=where)}"


def _highlight() -> str:
    """Bytes of tokens from the gaps between them; synonyms are single tokens here or phrases of several."""
    token = r"[\p{L}\p{N}\p{Co}]+"
    return f"""{_word("true", True)}, best AS (SELECT query_id, chunk_id FROM ranked WHERE rank0 < 20),
cut AS (SELECT chunk_id, content, regexp_extract_all(content, '{token}') AS ts, regexp_split_to_array(content, '{token}') AS gaps FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM best)),
at_ AS (SELECT chunk_id, p, ts[p + 1] AS t, CAST(list_sum(list_transform(gaps[1:p + 1], lambda g: strlen(g))) + coalesce(list_sum(list_transform(ts[1:p], lambda g: strlen(g))), 0) AS BIGINT) AS s FROM cut, unnest(range(0, len(ts))) AS r(p)),
tok AS (SELECT chunk_id, p, t, s, s + strlen(t) AS e, stem FROM at_ JOIN tk USING (chunk_id) JOIN stems ON token = ct[p + 1]),
mk AS (SELECT DISTINCT query_id, chunk_id, s, e, lower(t) AS t FROM tok JOIN wanted USING (stem) JOIN terms USING (term) JOIN best USING (query_id, chunk_id)),
grp AS (SELECT query_id, group_no, list(term) AS g FROM terms GROUP BY ALL), ev AS (SELECT query_id, chunk_id, s, group_no FROM mk JOIN grp USING (query_id) WHERE len(list_filter(g, lambda x: contains(t, x))) > 0),
nx AS (SELECT a.query_id, a.chunk_id, a.s, b.group_no, min(b.s) AS nxt FROM (SELECT DISTINCT query_id, chunk_id, s FROM ev) a JOIN ev b ON b.query_id = a.query_id AND b.chunk_id = a.chunk_id AND b.s >= a.s GROUP BY ALL),
sp AS (SELECT query_id, chunk_id, s, max(nxt) - s AS w, count(*) AS k FROM nx GROUP BY query_id, chunk_id, s), least_ AS (SELECT query_id, chunk_id, min(w) AS span FROM sp JOIN sizes USING (query_id) WHERE k = g GROUP BY ALL),
ms AS (SELECT query_id, chunk_id, string_agg(s || '-' || e, ',' ORDER BY s) AS marks, list(DISTINCT s) AS ss FROM mk GROUP BY ALL),
body AS (SELECT query_id, chunk_id, string_agg(gaps[i + 1] || CASE WHEN i >= len(ts) THEN '' WHEN list_contains(ss, s) THEN chr(2) || ts[i + 1] || chr(3) ELSE ts[i + 1] END, '' ORDER BY i) AS text
  FROM ms JOIN cut USING (chunk_id), unnest(range(0, len(ts) + 1)) AS r(i) LEFT JOIN at_ ON at_.chunk_id = cut.chunk_id AND at_.p = i GROUP BY ALL)
SELECT query_id, chunk_id, marks, span, sha256(text) AS text_sha, true AS strips FROM ms JOIN body USING (query_id, chunk_id) LEFT JOIN least_ USING (query_id, chunk_id)"""


#: The probe itself, part by part: a state is a folder that stands, the parts left, and the choices made so far.
_PROJECT_PATHS = r"""WITH RECURSIVE place AS (SELECT page_id, regexp_replace('/srv/' || regexp_replace(regexp_extract(url, '^[^:]*://([^?#]*)', 1), '/+$', '') || CASE WHEN page_id % 4 = 0 THEN '/.cache' ELSE '' END, '/+', '/', 'g') AS path FROM pages WHERE url IS NOT NULL),
names AS (SELECT DISTINCT translate(path, '/.', '--') AS m FROM place),
whole AS (SELECT DISTINCT path FROM place WHERE page_id % 10 <> 9), cut AS (SELECT path, string_split(path, '/') AS ps FROM whole),
dirs AS (SELECT DISTINCT array_to_string(ps[1:i], '/') AS path FROM cut, unnest(range(1, len(ps) + 1)) AS r(i)),
walk AS (SELECT m, '' AS at_, string_split(substr(m, 2), '-') AS rest, CAST([] AS BIGINT[]) AS taken FROM names
UNION ALL SELECT m, to_, rest[i + 1:], list_append(taken, i * 3 + kind) FROM (SELECT m, rest, taken, i, kind, CASE WHEN kind < 2 AND array_to_string(rest[1:i], '') = '' AND i = 1 THEN at_
  WHEN kind = 0 THEN at_ || '/' || array_to_string(rest[1:i], '-') WHEN kind = 1 THEN at_ || '/' || array_to_string(rest[1:i], '.') WHEN rest[1] = '' THEN at_ ELSE at_ || '/.' || rest[1] END AS to_
  FROM walk, unnest(range(1, len(rest) + 1)) AS r(i), unnest([0, 1, 2]) AS k(kind) WHERE kind = 0 OR kind = 1 AND i > 1 OR kind = 2 AND i = 1) t JOIN dirs ON dirs.path = to_),
done AS (SELECT m, at_ FROM walk WHERE len(rest) = 0 AND at_ IN (SELECT path FROM whole) QUALIFY row_number() OVER (PARTITION BY m ORDER BY taken) = 1)
SELECT m AS project_dir, at_ AS path FROM names LEFT JOIN done USING (m)"""


def _rrf() -> str:
    word = _SCORED.format(where="true")
    tri = word
    for name in ("counted", "scored", "sizes", "layer", "ranked", "hits", "terms", "lens", "corpus"):
        tri = tri.replace(f"{name} ", f"{name}_3 ").replace(f"{name},", f"{name}_3,").replace(f"{name})", f"{name}_3)")
    tri_hits = _TRI_HITS.replace("wanted", "wanted_3").replace("hits ", "hits_3 ").replace("FROM terms", "FROM terms_3")
    tri_lens = "lens_3 AS (SELECT chunk_id, greatest(0, length(title) - 2) + greatest(0, length(content) - 2) AS dl FROM chunks), corpus_3 AS (SELECT count(*) AS n, avg(dl) AS mean FROM lens_3)"
    terms = _terms(catalogue.QUERIES)
    return f"""WITH {TOKENS}, {terms}, {_WORD_HITS}, {word}, {terms.replace("terms(", "terms_3(")}, {tri_lens}, {tri_hits}, {tri},
two AS (SELECT *, 'porter' AS layer FROM ranked WHERE rank0 < 20 UNION ALL SELECT *, 'trigram' FROM ranked_3 WHERE rank0 < 20),
fused AS (SELECT query_id, source_id, title, sum(1.0 / (60 + rank0)) AS fused_score, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM two JOIN chunks USING (chunk_id) GROUP BY query_id, source_id, title)
SELECT query_id, source_id, title, round(fused_score, 6) AS fused_score, layers, CASE WHEN fused_score > 1.0 / 60 THEN 'rrf(porter+trigram)' ELSE split_part(layers, ',', 1) END AS match_layer FROM fused"""


_FINAL = f"""seg AS (SELECT CASE WHEN doc_id % 4 = 3 THEN 'new:' || (doc_id % 50) ELSE 'doc:' || doc_id END AS label, CASE WHEN doc_id % 4 = 2 THEN 'durable' ELSE ['durable', 'ephemeral', 'session'][doc_id % 3 + 1] END AS kind,
  CASE WHEN doc_id % 10 <> 0 THEN coalesce(text, '') || CASE WHEN doc_id % 4 = 1 THEN ' license!' ELSE '' END END AS text, doc_id AS seq FROM documents),
first_ AS (SELECT 'doc:' || doc_id AS label, ['durable', 'ephemeral', 'session'][doc_id % 3 + 1] AS kind, coalesce(text, '') AS text, doc_id FROM documents),
second_ AS (SELECT *, true AS later FROM seg QUALIFY row_number() OVER (PARTITION BY label ORDER BY seq DESC) = 1),
final_ AS (SELECT label, coalesce(s.kind, f.kind) AS kind, {_redacted("coalesce(s.text, f.text)")} AS text FROM first_ f FULL JOIN second_ s USING (label) WHERE later IS NULL OR s.text IS NOT NULL),
named AS MATERIALIZED (SELECT label, kind, text, row_number() OVER (ORDER BY label) AS source_id FROM final_)"""
_ACTIONS = f"""SELECT '0' AS of, 'insert' AS what, count(*) AS n FROM first_
UNION ALL SELECT '1', CASE WHEN f.label IS NULL THEN 'insert' WHEN s.text IS NULL THEN 'delete' WHEN {_redacted('f.text')} <> {_redacted('s.text')} THEN 'replace' WHEN f.kind <> s.kind THEN 'rekind' ELSE 'skip' END AS what, count(*)
  FROM second_ s LEFT JOIN first_ f USING (label) WHERE s.text IS NOT NULL OR f.label IS NOT NULL GROUP BY what
UNION ALL SELECT 'alive', kind, count(*) FROM final_ GROUP BY kind"""


_THROTTLE = """WITH RECURSIVE e AS (SELECT user_id AS client, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
f AS (SELECT client, i, t, t AS b, 1 AS n FROM e WHERE i = 1 UNION ALL SELECT e.client, e.i, e.t, CASE WHEN e.t - b > 36000000000 THEN e.t ELSE b END, CASE WHEN e.t - b > 36000000000 THEN 1 ELSE n + 1 END FROM f JOIN e ON e.client = f.client AND e.i = f.i + 1)
SELECT client, n AS count, CASE WHEN n > 8 THEN 0 WHEN n > 3 THEN 1 ELSE 2 END AS "limit", count(*) AS n FROM f GROUP BY client, f.n"""


def _raw() -> str:
    """Places of stems, phrases as joins of consecutive ones, and each query's condition spelt out."""
    phrases = {  # name: (tokens, the last is a prefix, only at the start)
        "the": ("the", 0, 0), "of_": ("of", 0, 0), "thi": ("thi", 1, 0), "und": ("und", 0, 0), "die": ("die", 0, 0), "der": ("der", 0, 0), "first_the": ("the", 0, 1), "of_the": ("of the", 0, 0),
        "of_the_th": ("of the th", 1, 0), "and_": ("and", 0, 0), "de": ("de", 0, 0), "la": ("la", 0, 0), "en": ("en", 1, 0),
    }

    def occurrences(name: str, tokens: str, prefix: int, first: int) -> str:
        ts = tokens.split()
        stems = [porter.stem(t) for t in ts]
        on = [f"p{i}.stem = {q(x)}" if not (prefix and i == len(ts) - 1) else f"starts_with(p{i}.stem, {q(x)})" for i, x in enumerate(stems)]
        joins = " ".join(f"JOIN pos p{i} ON p{i}.m = p0.m AND p{i}.pl = p0.pl + {i}" for i in range(1, len(ts)))
        return f"o_{name} AS MATERIALIZED (SELECT p0.m, p0.pl, {len(ts)} AS n FROM pos p0 {joins} WHERE {' AND '.join(on)}{' AND p0.pl = 0' if first else ''})"

    def near(name: str, parts: list[str], n: int) -> str:
        """Places of each part in a stretch that ends where some part begins and holds all."""
        ends = " UNION ".join(f"SELECT m, pl FROM o_{p}" for p in parts)
        inside = lambda p, e: f"{p}.m = {e}.m AND {p}.pl <= {e}.pl AND {p}.pl + {p}.n + {n} >= {e}.pl"
        whole = " AND ".join(f"EXISTS (SELECT 1 FROM o_{p} x WHERE {inside('x', 'e')})" for p in parts)
        lists = ", ".join(f"{name}_{p} AS MATERIALIZED (SELECT DISTINCT x.m, x.pl, x.n FROM o_{p} x JOIN {name} e ON {inside('x', 'e')})" for p in parts)
        return f"{name} AS MATERIALIZED (SELECT * FROM ({ends}) e WHERE {whole}), {lists}"

    # query: (table of places, its phrase) for each leaf, and the condition over leaves a, b, c ...
    asked = {
        1: ([("n1_the", "the"), ("n1_of_", "of_")], "a AND b"), 2: ([("o_thi", "thi"), ("o_of_", "of_")], "a AND NOT b"), 3: ([("o_und", "und"), ("o_die", "die"), ("o_der", "der")], "(a OR b) AND c"),
        4: ([("o_first_the", "first_the"), ("o_of_the", "of_the")], "a OR b"), 5: ([("o_of_the_th", "of_the_th"), ("o_and_", "and_")], "a AND NOT b"), 6: ([("o_de", "de"), ("o_la", "la")], "a AND b"),
        7: ([("n7_of_the", "of_the"), ("n7_and_", "and_"), ("n7_en", "en"), ("o_the", "the")], "a AND b AND c AND d"),
    }
    leaves = " UNION ALL ".join(f"SELECT {i} AS query_id, {k} AS leaf, '{phrase}' AS phrase, m, count(*) AS tf FROM {table} GROUP BY m" for i, (ls, _) in asked.items() for k, (table, phrase) in enumerate(ls))
    counted = " UNION ALL ".join(f"SELECT '{p}' AS phrase, count(DISTINCT m) AS df FROM o_{p}" for p in phrases)
    flags = ", ".join(f"coalesce(bool_or(leaf = {k}), false) AS {c}" for k, c in enumerate("abcd"))
    meets = " OR ".join(f"query_id = {i} AND ({cond})" for i, (_, cond) in asked.items())
    return f"""WITH {ROLES}, tk AS (SELECT CAST(session AS BIGINT) * 1048576 + line_no AS m, {_tokens("text")} AS t FROM turned), every_ AS (SELECT DISTINCT unnest(t) AS token FROM tk), {_porter("every_")},
pos AS MATERIALIZED (SELECT m, i - 1 AS pl, stem FROM tk, unnest(range(1, len(t) + 1)) AS r(i) JOIN stems ON token = t[i]), lens AS (SELECT m, len(t) AS dl FROM tk), corpus AS (SELECT count(*) AS n, avg(dl) AS mean FROM lens),
{", ".join(occurrences(k, *v) for k, v in phrases.items())}, {near("n1", ["the", "of_"], 2)}, {near("n7", ["of_the", "and_", "en"], 4)},
leaves AS ({leaves}), dfs AS ({counted}),
scored AS (SELECT query_id, leaf, m, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS score FROM leaves JOIN dfs USING (phrase) JOIN lens USING (m), corpus),
met AS (SELECT query_id, m, sum(score) AS score, {flags} FROM scored GROUP BY query_id, m)
SELECT query_id, m // 1048576 AS session, CAST(m % 1048576 AS INTEGER) AS line_no, round(score, 6) AS score FROM met WHERE {meets}"""


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(x if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def _search(queries, entities, limit: int = 10) -> str:
    """The whole search for queries of plain words, with the entities (single words) that they name: both passes (ps 0: as asked, 1: corrected) go through the
    same steps side by side."""
    synonyms = sorted({(t, x) for g in lexicon.SYNONYM_GROUPS for t in g.split() for x in lexicon.synonyms(t)})
    known = words_in({t for g in lexicon.SYNONYM_GROUPS for t in g.split()} | lexicon.STOPWORDS)
    stop, keyword = words_in(lexicon.STOPWORDS), words_in(w.lower() for w in lexicon.QUERY_KEYWORDS)
    return f"""WITH {VOCAB}, {BARE}, tk AS MATERIALIZED (SELECT chunk_id, {_tokens("title")} AS tt, {_tokens("content")} AS ct FROM chunks),
{_values("asked", "query_id, query", [(i, q(x)) for i, x in queries])}, {_values("syn", "w, alt", [(q(a), q(b)) for a, b in synonyms])},
v AS (SELECT word AS other, min(chunk_id * 1048576 + no) AS seq FROM vw GROUP BY 1),
rawq AS (SELECT query_id, no, l[no] AS word FROM (SELECT query_id, string_split(lower(query), ' ') AS l FROM asked) t, unnest(range(1, len(l) + 1)) AS r(no)),
open_ AS (SELECT DISTINCT word, CASE WHEN strlen(word) <= 4 THEN 1 WHEN strlen(word) <= 12 THEN 2 ELSE 3 END AS m FROM rawq WHERE strlen(word) >= 3 AND word NOT IN {known} AND word NOT IN (SELECT other FROM v)),
fixed AS (SELECT word, other FROM (SELECT word, other, seq, levenshtein(word, other) AS d, m FROM open_ JOIN v ON strlen(other) BETWEEN strlen(word) - m AND strlen(word) + m) t WHERE d <= m QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, seq, other) = 1),
each_ AS (SELECT 0 AS ps, query_id, no, word FROM rawq UNION ALL SELECT 1, query_id, no, coalesce(other, word) FROM rawq LEFT JOIN fixed USING (word) WHERE query_id IN (SELECT query_id FROM rawq JOIN fixed USING (word))),
own AS (SELECT ps, query_id, min(no) AS g, word AS w FROM each_ GROUP BY ALL),
qt AS MATERIALIZED (SELECT * FROM own o WHERE w NOT IN {stop} OR NOT EXISTS (SELECT 1 FROM own p WHERE p.ps = o.ps AND p.query_id = o.query_id AND p.w NOT IN {stop})),
qn AS (SELECT ps, query_id, count(*) AS k FROM qt GROUP BY ALL),
wide AS (SELECT ps, query_id, g, w AS term, 0 AS extra FROM qt UNION SELECT ps, query_id, g, alt, 1 FROM qt JOIN syn USING (w)),
terms AS MATERIALIZED (SELECT ps, query_id, strict, layer, g, term FROM wide, (VALUES (0), (1)) s(strict), (VALUES ('porter'), ('trigram')) l(layer)
  WHERE (strict = 1 OR extra = 0) AND CASE layer WHEN 'porter' THEN g NOT IN (SELECT b.g FROM qt b WHERE b.ps = wide.ps AND b.query_id = wide.query_id AND b.w IN {keyword}) ELSE length(term) >= 3 END),
sizes AS (SELECT ps, query_id, strict, layer, count(DISTINCT g) AS n FROM terms GROUP BY ALL),
every_ AS (SELECT DISTINCT token FROM (SELECT unnest(list_concat(tt, ct)) AS token FROM tk) t UNION SELECT DISTINCT term FROM wide), {_porter("every_")},
places AS (SELECT chunk_id, 0 AS c, unnest(tt) AS token FROM tk UNION ALL SELECT chunk_id, 1, unnest(ct) FROM tk),
wanted AS (SELECT DISTINCT term, stem FROM wide JOIN stems ON token = term),
low AS MATERIALIZED (SELECT chunk_id, lower(title) AS t, lower(content) AS c FROM chunks),
hits AS MATERIALIZED (SELECT 'porter' AS layer, term, chunk_id, count(*) FILTER (WHERE c = 0) AS th, count(*) FILTER (WHERE c = 1) AS ch FROM places JOIN stems USING (token) JOIN wanted USING (stem) GROUP BY ALL
  UNION ALL SELECT 'trigram', term, chunk_id, len(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, length(term)) = term)), CASE WHEN contains(c, term) THEN len(list_filter(range(1, length(c) + 1), lambda i: substr(c, i, length(term)) = term)) ELSE 0 END
  FROM low, (SELECT DISTINCT term FROM terms WHERE layer = 'trigram') x WHERE contains(c, term) OR contains(t, term)),
lens AS (SELECT 'porter' AS layer, chunk_id, len(tt) + len(ct) AS dl FROM tk UNION ALL SELECT 'trigram', chunk_id, greatest(0, length(title) - 2) + greatest(0, length(content) - 2) FROM chunks),
corpus AS (SELECT layer, count(*) AS total, avg(dl) AS mean FROM lens GROUP BY layer), counted AS (SELECT layer, term, count(*) AS df FROM hits GROUP BY ALL),
scored AS MATERIALIZED (SELECT layer, term, chunk_id, -(CASE WHEN ln((total - df + 0.5) / (df + 0.5)) > 0 THEN ln((total - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * (2.0 * th + ch) * 2.2 / ((2.0 * th + ch) + 1.2 * (0.25 + 0.75 * dl / mean)) AS score
  FROM hits JOIN counted USING (layer, term) JOIN lens USING (layer, chunk_id) JOIN corpus USING (layer)),
met AS (SELECT ps, query_id, strict, layer, chunk_id, round(sum(score), 9) AS score, count(DISTINCT g) AS met FROM terms JOIN scored USING (layer, term) GROUP BY ALL),
ranked AS (SELECT m.*, c.source_id, c.title, row_number() OVER (PARTITION BY ps, query_id, strict, layer ORDER BY score, chunk_id) - 1 AS rank0 FROM met m JOIN sizes USING (ps, query_id, strict, layer) JOIN chunks c USING (chunk_id) JOIN bare USING (source_id)
  WHERE (strict = 0 OR met = n) AND bare.kind IN ('durable', 'session')),
fused AS (SELECT ps, query_id, strict, source_id, title, sum(1.0 / (60 + rank0)) AS f, arg_min(chunk_id, (score, layer, chunk_id)) AS chunk_id, min(layer) AS one FROM ranked WHERE rank0 < {max(5 * limit, 10)} GROUP BY ALL),
best AS MATERIALIZED (SELECT * FROM fused QUALIFY strict = max(strict) OVER (PARTITION BY ps, query_id)),
tb AS (SELECT ps, query_id, source_id, title, chunk_id, 1.0 + 0.3 * count(*) FILTER (WHERE contains(lower(title), w)) / count(*) AS boost, count(*) AS k FROM best JOIN qt USING (ps, query_id) GROUP BY ALL),
cand AS MATERIALIZED (SELECT DISTINCT ps, query_id, chunk_id FROM tb WHERE k > 1), shown AS (SELECT DISTINCT chunk_id FROM cand),
pieces AS (SELECT chunk_id, regexp_extract_all(c, '[^\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}]+') AS l FROM low JOIN shown USING (chunk_id)),
cw AS (SELECT chunk_id, i, regexp_replace(l[i], '^[^\\p{{L}}\\p{{N}}]*', '') AS w, strlen(l[i]) AS n FROM pieces, unnest(range(1, len(l) + 1)) AS r(i)),
spots AS MATERIALIZED (SELECT chunk_id, w, sum(n) OVER (PARTITION BY chunk_id ORDER BY i) - strlen(w) AS p FROM cw),
marks AS (SELECT ps, query_id, chunk_id, w, p FROM cand JOIN spots USING (chunk_id) JOIN stems ON token = w WHERE EXISTS (SELECT 1 FROM wide d JOIN stems e ON e.token = d.term WHERE d.ps = cand.ps AND d.query_id = cand.query_id AND e.stem = stems.stem)),
near AS (SELECT DISTINCT ps, query_id, chunk_id, g, p FROM marks JOIN wide USING (ps, query_id) WHERE contains(w, term)),
whole AS (SELECT ps, query_id, chunk_id FROM near JOIN qn USING (ps, query_id) GROUP BY ps, query_id, chunk_id, k HAVING count(DISTINCT g) = k),
loose AS (SELECT DISTINCT ps, query_id, chunk_id, g, strlen(substr(c, 1, i - 1)) AS p FROM cand JOIN low USING (chunk_id) JOIN wide USING (ps, query_id), unnest(range(1, length(c) + 1)) AS r(i) WHERE substr(c, i, length(term)) = term AND (ps, query_id, chunk_id) NOT IN (SELECT (ps, query_id, chunk_id) FROM whole)),
at_ AS (SELECT near.* FROM near JOIN whole USING (ps, query_id, chunk_id) UNION ALL SELECT loose.* FROM loose JOIN (SELECT ps, query_id, chunk_id FROM loose JOIN qn USING (ps, query_id) GROUP BY ps, query_id, chunk_id, k HAVING count(DISTINCT g) = k) f USING (ps, query_id, chunk_id)),
nexts AS (SELECT a.ps, a.query_id, a.chunk_id, a.p, b.g, min(b.p) AS nxt FROM (SELECT DISTINCT ps, query_id, chunk_id, p FROM at_) a JOIN at_ b ON b.ps = a.ps AND b.query_id = a.query_id AND b.chunk_id = a.chunk_id AND b.p >= a.p GROUP BY ALL),
spans AS (SELECT ps, query_id, chunk_id, min(span) AS span FROM (SELECT ps, query_id, chunk_id, p, max(nxt) - p AS span, count(*) AS c FROM nexts GROUP BY ps, query_id, chunk_id, p) s JOIN qn USING (ps, query_id) WHERE c = k GROUP BY ALL),
rated AS (SELECT b.*, round(f * boost * coalesce(1.0 + 1.0 / (1.0 + span / greatest(strlen(c.content), 1)), 1.0), 9) AS score FROM best b JOIN tb USING (ps, query_id, source_id, title, chunk_id) JOIN chunks c USING (chunk_id) LEFT JOIN spans USING (ps, query_id, chunk_id)),
firsts_ AS (SELECT query_id, count(*) AS n FROM rated WHERE ps = 0 GROUP BY 1),
joined AS (SELECT * FROM rated r WHERE ps = 0 OR coalesce((SELECT n FROM firsts_ WHERE firsts_.query_id = r.query_id), 0) < {limit} AND NOT EXISTS (SELECT 1 FROM rated o WHERE o.ps = 0 AND o.query_id = r.query_id AND o.source_id = r.source_id AND o.title = r.title)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ps, score DESC, source_id, title) AS place FROM joined),
turns AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY place) > 2 AS late FROM placed),
spread AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, place) AS nth FROM turns QUALIFY nth <= {limit}),
{_values("names", "query_id, name", [(i, q(x)) for i, x in entities])},
counts AS (SELECT query_id, chunk_id, least(5, sum(len(regexp_extract_all(content, '\\b' || name || '\\b')))) AS found FROM names JOIN spread USING (query_id) JOIN chunks USING (chunk_id) GROUP BY ALL),
final AS (SELECT s.*, s.score * (1.0 + 0.3 * coalesce(found, 0)) AS shown_score, found IS NOT NULL AS named FROM spread s LEFT JOIN counts USING (query_id, chunk_id))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN named THEN -shown_score ELSE 0 END, nth) AS INTEGER) AS rank, source_id, title, round(shown_score, 6) AS fused_score,
  CASE WHEN ps = 1 THEN 'fuzzy+' ELSE '' END || CASE WHEN f > 1.0 / 60 THEN 'rrf(porter+trigram)' ELSE one END AS match_layer FROM final"""


BARE = f"bare AS (SELECT doc_id AS source_id, 'doc:' || doc_id AS label, ['durable', 'ephemeral', 'session'][doc_id % 3 + 1] AS kind, {DAY0} + to_days(CAST(doc_id % 90 AS INTEGER)) AS indexed_at, sha256(text) AS content_hash FROM documents)"
SOURCES = f"""{CHUNKS}, {BARE},
log AS (SELECT user_id AS source_id, count(*) AS access_count, max(ts) AS last_accessed_at FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id),
pieces AS (SELECT source_id, count(*) AS chunk_count, sum(length(content)) AS content_bytes FROM chunks GROUP BY source_id),
sources AS (SELECT bare.*, coalesce(access_count, 0) AS access_count, last_accessed_at, coalesce(chunk_count, 0) AS chunk_count, coalesce(content_bytes, 0) AS content_bytes,
  CASE WHEN source_id % 5 = 0 THEN coalesce(chunk_count, 0) WHEN source_id % 5 = 1 THEN 1 ELSE 0 END AS code FROM bare LEFT JOIN log USING (source_id) LEFT JOIN pieces USING (source_id)),
days AS (SELECT *, greatest(0, epoch({AS_OF}) - epoch(indexed_at)) / 86400.0 AS age, greatest(0, epoch({AS_OF}) - epoch(last_accessed_at)) / 86400.0 AS idle FROM sources),
rated0 AS (SELECT *, (CASE WHEN code > 0 AND code = chunk_count THEN 0.7 WHEN code > 0 THEN 0.6 ELSE 0.5 END + least(0.2, access_count * 0.02)) * exp(-0.045 * age)
  + 0.3 * CASE WHEN access_count > 0 AND last_accessed_at IS NOT NULL THEN 1.0 / (1.0 + idle) ELSE 0 END AS score FROM days),
rated AS (SELECT *, CASE WHEN kind <> 'durable' THEN CASE WHEN epoch({AS_OF}) - epoch(indexed_at) > CASE kind WHEN 'ephemeral' THEN 86400 ELSE 5184000 END THEN 'stale' ELSE 'fresh' END
  WHEN score >= 0.7 THEN 'hot' WHEN score >= 0.4 THEN 'warm' WHEN score >= 0.15 THEN 'cold' ELSE 'evictable' END AS tier FROM rated0),
candidates AS (SELECT source_id, kind, CASE WHEN content_bytes > 20000 THEN 'oversized' WHEN kind = 'durable' AND score < 0.15 AND access_count = 0 THEN 'retention' WHEN tier = 'stale' THEN 'ttl_' || kind END AS eviction_reason FROM rated)"""

INCOMING = """incoming AS (SELECT CASE WHEN doc_id % 4 = 3 THEN 'new:' || (doc_id % 50) ELSE 'doc:' || doc_id END AS label, CASE WHEN doc_id % 4 = 2 THEN 'durable' ELSE ['durable', 'ephemeral', 'session'][doc_id % 3 + 1] END AS kind,
  sha256(CASE WHEN doc_id % 4 = 1 THEN text || '!' ELSE text END) AS content_hash, doc_id AS seq FROM documents),
lasts AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY label ORDER BY seq DESC) = 1),
plan AS (SELECT l.*, CASE WHEN b.source_id IS NULL THEN 'insert' WHEN b.content_hash <> l.content_hash THEN 'replace' WHEN b.kind <> l.kind THEN 'rekind' ELSE 'skip' END AS action FROM lasts l LEFT JOIN bare b USING (label))"""

PAIRS = f"""msgs AS (SELECT CAST(conv_id AS VARCHAR) AS session, conv_id, turn, CASE role WHEN 'system' THEN 'away_summary' ELSE role END AS role, {trim("text")} AS text FROM conversations WHERE {trim("text")} <> ''),
isl AS (SELECT *, sum(CASE WHEN role IN ('user', 'away_summary') THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn) AS island FROM msgs),
grp AS (SELECT session, conv_id, island, arg_min(role, turn) AS first, arg_min(text, turn) AS human, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS assistant FROM isl WHERE island > 0 GROUP BY ALL),
pairs AS (SELECT session, conv_id, CAST(row_number() OVER (PARTITION BY session ORDER BY island) - 1 AS INTEGER) AS pair_no, CASE first WHEN 'away_summary' THEN '' ELSE human END AS human,
  CASE first WHEN 'away_summary' THEN human ELSE assistant END AS assistant FROM grp WHERE first = 'away_summary' OR assistant <> ''),
rendered AS (SELECT *, CASE WHEN human = '' THEN '[Session summary: ' || assistant || ']' || chr(10) ELSE 'Human: ' || human || chr(10) || 'Assistant: ' || assistant || chr(10) END AS text FROM pairs)"""
WINDOWS = f"""{PAIRS},
per AS (SELECT session, conv_id, count(*) AS n, sum(strlen(text) + 1) - 1 AS bytes FROM rendered GROUP BY ALL),
spans AS (SELECT session, conv_id, 0 AS first, n - 1 AS last FROM per WHERE bytes <= 1500
  UNION ALL SELECT session, conv_id, i * 3, least(i * 3 + 3, n - 1) FROM per, unnest(range(0, CAST(greatest(0, ceil((n - 4) / 3.0)) AS BIGINT) + 1)) AS r(i) WHERE bytes > 1500),
wins AS (SELECT s.session, s.conv_id, first, last, {trim("string_agg(text, chr(10) ORDER BY pair_no)")} AS content FROM spans s JOIN rendered r ON r.session = s.session AND pair_no BETWEEN first AND last GROUP BY ALL)"""


_REDUCED = """reduced AS (SELECT query_id, content_type, CASE WHEN needle IS NULL AND query_id % 10 = 9 THEN 1.0 ELSE (query_id % 8) / 8 END AS compression, CASE WHEN needle IS NOT NULL THEN context_recall WHEN query_id % 10 = 9 THEN 1.0 ELSE 0.0 END AS recall,
  CASE WHEN needle IS NOT NULL THEN CASE WHEN context_recall = 1 THEN 1.0 ELSE 0.0 END WHEN query_id % 10 = 9 THEN 1.0 ELSE 0.0 END AS perfect, CASE WHEN needle IS NOT NULL THEN (query_id % 8) / 8 * context_recall WHEN query_id % 10 = 9 THEN 1.0 ELSE 0.0 END AS effective FROM metrics)"""


def _found() -> str:
    return """items AS (SELECT item_id AS query_id, text FROM benchmark),
base AS (SELECT query_id, doc_id, d.text AS content FROM documents d JOIN items i ON contains(d.text, i.text) UNION SELECT item_id, d.doc_id, d.text FROM benchmark, unnest([item_id * 2, item_id * 2 + 1]) AS r(x) JOIN documents d ON d.doc_id = x),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM (SELECT DISTINCT * FROM base)),
cases AS (SELECT item_id AS query_id, CASE WHEN item_id % 5 = 4 THEN NULL ELSE text END AS needle, 't' || (item_id % 3) AS content_type FROM benchmark),
rel AS (SELECT f.query_id, f.rank, coalesce(contains(content, needle), false) AS relevant, needle FROM found f JOIN cases USING (query_id)),
agg AS (SELECT query_id, max(CASE WHEN relevant AND rank <= 1 THEN 1.0 ELSE 0.0 END) AS r1, max(CASE WHEN relevant AND rank <= 3 THEN 1.0 ELSE 0.0 END) AS r3, max(CASE WHEN relevant AND rank <= 5 THEN 1.0 ELSE 0.0 END) AS r5,
  max(CASE WHEN relevant AND rank <= 10 THEN 1.0 ELSE 0.0 END) AS r10, sum(CASE WHEN relevant AND rank <= 10 THEN 1.0 / log2(rank + 1) END) AS gain, count(*) FILTER (WHERE relevant AND rank <= 10) AS k,
  min(rank) FILTER (WHERE relevant) AS first, bool_or(relevant) AS any_found, count(*) AS returned FROM rel GROUP BY query_id),
metrics AS (SELECT c.query_id, c.content_type, c.needle, coalesce(r1, 0) AS recall_at_1, coalesce(r3, 0) AS recall_at_3, coalesce(r5, 0) AS recall_at_5, coalesce(r10, 0) AS recall_at_10,
  coalesce(CASE WHEN k > 0 THEN gain / list_sum(list_transform(range(1, k + 1), lambda i: 1.0 / log2(i + 1))) END, 0) AS ndcg_at_10, coalesce(1.0 / first, 0) AS mrr,
  CASE WHEN needle IS NULL THEN 1.0 WHEN any_found THEN 1.0 ELSE 0.0 END AS context_recall, needle IS NULL AND coalesce(returned, 0) > 0 AS false_positive FROM cases c LEFT JOIN agg USING (query_id))"""


ARCHIVE = f"""archive AS (SELECT format('{{:08d}}-aaaa', conv_id) AS session, conv_id, count(*) AS message_count, CAST(sum(strlen(text)) AS BIGINT) AS size_bytes, {DAY0} + to_hours(CAST(conv_id AS INTEGER)) AS start_time,
  CASE WHEN conv_id % 5 > 0 THEN {DAY0} + to_hours(CAST(conv_id AS INTEGER)) + INTERVAL 1 MINUTE END AS end_time, '/home/p' || (conv_id % 7) AS project_path, 'm' || (conv_id % 2) AS machine_id FROM conversations GROUP BY conv_id)"""
ROLES = f"""rows_ AS (SELECT CAST(conv_id AS VARCHAR) AS session, CAST(turn AS INTEGER) AS line_no, role, {_redacted(trim("CASE role WHEN 'assistant' THEN " + trim("text") + " || chr(10) || 'Read /f/' || turn ELSE text END"))} AS text FROM conversations),
turns AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line_no) AS nth FROM rows_ WHERE text <> ''),
turned AS (SELECT *, CAST(sum(CASE WHEN role = 'user' AND nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY line_no) AS INTEGER) AS turn_index FROM turns)"""

_STATS = "SELECT kind || '.' || tier AS metric, count(*) AS value FROM rated GROUP BY ALL UNION ALL SELECT 'sources', count(*) FROM rated UNION ALL SELECT 'chunks', count(*) FROM chunks"
_SIZES = "sized AS (SELECT bare.*, coalesce(chunk_rows, 0) AS chunk_rows, CAST(coalesce(content_bytes, 0) AS BIGINT) AS content_bytes FROM bare LEFT JOIN (SELECT source_id, count(*) AS chunk_rows, sum(length(content)) AS content_bytes FROM chunks GROUP BY source_id) USING (source_id))"


def _query_terms() -> str:
    """Terms of users' messages, numbered, with the synonyms of each."""
    synonyms = ", ".join(f"({q(t)}, {q(x)})" for t, x in sorted({(t, x) for g in lexicon.SYNONYM_GROUPS for t in g.split() for x in lexicon.synonyms(t)}))
    words = f"list_filter(list_transform(regexp_split_to_array({trim('t')}, '[\\t\\n\\x0B\\f\\r ]+'), lambda x: lower(trim(x, '.,!?;:'))), lambda x: x <> '')"
    return rf"""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, regexp_replace(coalesce(text, ''), '[''"(){{}}\[\]*:^~]', ' ', 'g') AS t FROM conversations WHERE role = 'user'),
w AS (SELECT query_id, {words} AS ws FROM q), u AS (SELECT query_id, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS ws FROM w),
k AS (SELECT query_id, ws, list_filter(ws, lambda x: x NOT IN {words_in(lexicon.STOPWORDS)}) AS kept FROM u),
e AS (SELECT query_id, CASE WHEN len(kept) = 0 THEN ws ELSE kept END AS ws FROM k), g AS (SELECT query_id, CAST(i - 1 AS INTEGER) AS group_no, ws[i] AS term FROM e, unnest(range(1, len(ws) + 1)) AS r(i)),
own AS (SELECT * FROM g WHERE upper(term) NOT IN {words_in(lexicon.QUERY_KEYWORDS)}), syn(term, other) AS (VALUES {synonyms})
SELECT * FROM own UNION ALL SELECT query_id, group_no, other FROM own JOIN syn USING (term)"""


def _entities() -> str:
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '"[^"]+"', ' ', 'g') AS rest FROM documents),
p AS (SELECT doc_id, rest, list_filter(list_transform(regexp_extract_all(text, '"([^"]+)"', 1), lambda x: {trim("x")}), lambda x: strlen(x) >= 2) AS phrases, regexp_extract_all(rest, '\b[A-Z][a-zA-Z0-9_.\-]+\b') AS ids FROM d),
k AS (SELECT doc_id, list_concat(phrases, list_filter(ids, lambda x, i: x NOT IN {words_in(lexicon.ENTITY_STOPWORDS)} AND strlen(x) >= 2
  AND NOT (i = 1 AND starts_with({trim("rest")}, x) AND NOT regexp_matches(x, '[_.]|[a-z][A-Z]|[A-Z][A-Z][a-z]')))) AS es FROM p),
u AS (SELECT doc_id, list_filter(es, lambda x, i: list_position(es, x) = i) AS es FROM k)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS no, es[i] AS entity FROM u, unnest(range(1, len(es) + 1)) AS r(i)"""


def oracle_sql() -> dict[str, str]:
    fuzzy = " UNION ".join(f"SELECT {q(w)} AS word" for w in sorted({w for _, s in catalogue.TYPOS for w in s.split()}))
    known = words_in({t for g in lexicon.SYNONYM_GROUPS for t in g.split()} | lexicon.STOPWORDS)
    return {
        "redact_secrets": f"SELECT doc_id, {sha(_redacted('text'))} AS redacted_sha, {_redacted('text')} <> text AS changed FROM documents",
        "content_hash_dedup": "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
        "size_guard_rejects": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE strlen(text) > 10000",
        "detect_content_type": rf"""WITH every AS (SELECT 'documents' AS of_, text AS x FROM documents UNION ALL SELECT 'events', props FROM events UNION ALL SELECT 'pages', html FROM pages),
bare AS (SELECT of_, {trim("coalesce(x, '')")} AS x FROM every), pieces AS (SELECT of_, x, string_split(x, chr(10)) AS l FROM bare),
marks AS (SELECT of_, x, list_sum(list_transform(list_concat(l[1:49], CASE WHEN len(l) > 49 THEN [array_to_string(l[50:], chr(10))] ELSE [] END), lambda t: CAST(starts_with(trim(t), '#') AS INT) + CAST(starts_with(trim(t), '```') AS INT) + CAST(contains(t, '](') AS INT))) >= 2 AS md FROM pieces)
SELECT of_ AS of, CASE WHEN x[1] IN ('{{', '[') AND json_valid(x) THEN 'json' WHEN md THEN 'markdown' ELSE 'plaintext' END AS kind, count(*) AS n FROM marks GROUP BY ALL""",
        "chunk_plaintext": f"WITH {CHUNKS} SELECT source_id, chunk_no, title, sha256(content) AS content_sha FROM chunks",
        "chunk_code_flag": r"SELECT doc_id, regexp_matches(CASE WHEN doc_id % 2 = 0 THEN '```py' || chr(10) || text || chr(10) || '```' ELSE text END, '(?s)```[0-9A-Za-z_]*\n.*?```') AS has_code FROM documents",
        "vocabulary": f"WITH {VOCAB} SELECT word, chunk_id, CAST(no AS INTEGER) AS no FROM vw QUALIFY row_number() OVER (PARTITION BY word ORDER BY chunk_id, no) = 1",
        "doc_frequency": f"WITH {VOCAB} SELECT word, count(DISTINCT chunk_id) AS df FROM vw GROUP BY word",
        "distinctive_terms": f"""WITH {VOCAB}, n AS (SELECT source_id, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) >= 3), df AS (SELECT source_id, word, count(DISTINCT chunk_no) AS df FROM vw GROUP BY 1, 2),
s AS (SELECT source_id, word, ln(n / df) + least(strlen(word) / 20.0, 0.5) + CASE WHEN contains(word, '_') THEN 1.5 WHEN strlen(word) >= 12 THEN 0.8 ELSE 0 END AS score FROM df JOIN n USING (source_id) WHERE df >= 2 AND df <= greatest(3, ceil(n * 0.4))),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY score DESC, word) AS INTEGER) AS rank FROM s) SELECT source_id, rank, word, round(score, 6) AS score FROM r WHERE rank <= 40""",
        "bm25_word_topk": f"{_word('true', True)} {_TOP}",
        "bm25_word_or": f"{_word('true')} {_TOP}",
        "index_stats": f"WITH {TOKENS} SELECT n, round(mean, 6) AS words, (SELECT round(avg(greatest(0, length(title) - 2) + greatest(0, length(content) - 2)), 6) FROM chunks) AS grams FROM corpus",
        "vault_raw_search": _raw(),
        "index_segments": _word("true").replace(RED, f"{_FINAL}, red AS (SELECT source_id, text FROM named)")
        + " SELECT query_id, label, chunk_no, round(score, 6) AS score FROM layer JOIN chunks USING (chunk_id) JOIN named USING (source_id)",
        "segment_actions": f"WITH {_FINAL} {_ACTIONS}",
        "porter_search": f"{_word('met = g', True)} {_TOP}",
        "full_search_pipeline": _search(catalogue.QUERIES + catalogue.TYPOS, [(2, "License")]),
        "bm25_word_and": f"{_word('met = g')} {_TOP}",
        "bm25_trigram_topk": f"{_tri('true')} {_TOP}",
        "rrf_fusion": _rrf(),
        "title_boost": f"""WITH {CHUNKS}, {_terms(catalogue.QUERIES)}, ts AS (SELECT query_id, list(DISTINCT term) AS ts FROM terms GROUP BY query_id),
h AS (SELECT query_id, chunk_id, chunk_no, len(ts) AS n, len(list_filter(ts, lambda t: contains(lower(title), t))) AS hits FROM chunks, ts WHERE title <> 'Output')
SELECT query_id, chunk_id, round(1.0 + CASE WHEN chunk_no % 2 = 0 THEN 0.6 ELSE 0.3 END * hits / n, 6) AS boost FROM h WHERE hits > 0""",
        "diversify": f"""WITH {CHUNKS}, r AS (SELECT source_id, chunk_id, row_number() OVER (ORDER BY length(content) DESC, chunk_id) AS rank FROM chunks),
l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source_id ORDER BY rank) > 2 THEN 1 ELSE 0 END AS late FROM r), p AS (SELECT *, CAST(row_number() OVER (ORDER BY late, rank) AS INTEGER) AS place FROM l)
SELECT 1 AS query_id, source_id, chunk_id, place FROM p WHERE place <= 50""",
        "kind_filter": f"WITH {BARE} SELECT source_id, label, kind FROM bare WHERE kind IN ('durable', 'session')",
        "source_filter": f"WITH {BARE} SELECT source_id, label, kind FROM bare WHERE label ILIKE '%DOC:1_%'",
        "proximity_span": f"""WITH {TOKENS}, {_terms(catalogue.QUERIES)}, pos_ AS (SELECT query_id, chunk_id, group_no, p FROM terms JOIN (SELECT chunk_id, p, ct[p + 1] AS term FROM tk, unnest(range(0, len(ct))) AS r(p)) USING (term)),
gs AS (SELECT query_id, count(DISTINCT group_no) AS gn FROM terms GROUP BY 1), ok AS (SELECT query_id, chunk_id FROM pos_ JOIN gs USING (query_id) GROUP BY query_id, chunk_id, gn HAVING count(DISTINCT group_no) = gn),
nx AS (SELECT a.query_id, a.chunk_id, a.p, b.group_no, min(b.p) AS nxt FROM pos_ a JOIN ok USING (query_id, chunk_id) JOIN pos_ b ON b.query_id = a.query_id AND b.chunk_id = a.chunk_id AND b.p >= a.p GROUP BY ALL),
sp AS (SELECT query_id, chunk_id, p, max(nxt) - p AS span, count(*) AS k FROM nx GROUP BY query_id, chunk_id, p) SELECT query_id, chunk_id, CAST(min(span) AS INTEGER) AS span FROM sp JOIN gs USING (query_id) WHERE k = gn GROUP BY query_id, chunk_id""",
        "snippet_windows": """WITH h AS (SELECT doc_id AS id, length(text) AS n, i - 1 AS pos FROM documents, unnest(range(1, length(text) + 1)) AS r(i) WHERE contains(lower(text), 'license') AND substr(lower(text), i, 7) = 'license'),
s AS (SELECT id, pos, greatest(0, pos - 300) AS s, least(n, pos + 300) AS e FROM h), m AS (SELECT *, CASE WHEN lag(e) OVER w IS NULL OR s > lag(e) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY id ORDER BY pos)),
i AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY pos) AS isl FROM m) SELECT id, CAST(min(s) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS end_ FROM i GROUP BY id, isl""",
        "highlight": _highlight(),
        "synonym_expand": _query_terms(),
        "and_or_fallback": f"""{_word("true", queries=((1, "general public license"), (5, "pathetic apache"), (6, "idiot general scum trash loser")))}, full_ AS (SELECT query_id, chunk_id FROM layer JOIN sizes USING (query_id) WHERE met = g)
SELECT query_id, chunk_id, 'and' AS mode, round(score, 6) AS score FROM layer JOIN full_ USING (query_id, chunk_id) UNION ALL SELECT query_id, chunk_id, 'or', round(score, 6) FROM layer WHERE query_id NOT IN (SELECT query_id FROM full_)""",
        "fuzzy_correct": f"""WITH {VOCAB}, v AS (SELECT word AS other, min(chunk_id * 1048576 + no) AS seq FROM vw GROUP BY 1), w AS ({fuzzy}),
o AS (SELECT word, CASE WHEN strlen(word) <= 4 THEN 1 WHEN strlen(word) <= 12 THEN 2 ELSE 3 END AS m FROM w WHERE strlen(word) >= 3 AND word NOT IN {known} AND word NOT IN (SELECT other FROM v)),
n AS (SELECT word, other, seq, levenshtein(word, other) AS d, m FROM o JOIN v ON strlen(other) BETWEEN strlen(word) - m AND strlen(word) + m),
b AS (SELECT word, other FROM n WHERE d <= m QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, seq, other) = 1) SELECT word, other AS fixed FROM w LEFT JOIN b USING (word)""",
        "entity_extract": _entities(),
        "entity_boost": r"""WITH m AS (SELECT doc_id, least(5, len(regexp_extract_all(text, '\bMIT\b')) + len(regexp_extract_all(text, '(?i)\bApache License\b')) + len(regexp_extract_all(text, '\bPublic\b'))) AS n FROM documents)
SELECT doc_id, round(1.0 + 0.3 * n, 6) AS boost FROM m WHERE n > 0""",
        "retention_tiers": f"WITH {SOURCES} SELECT source_id, tier, round(score, 6) AS retention_score FROM rated WHERE kind = 'durable'",
        "ttl_buckets": f"WITH {SOURCES} SELECT kind, tier, count(*) AS n FROM rated WHERE kind <> 'durable' GROUP BY ALL",
        "cleanup_candidates": f"WITH {SOURCES} SELECT source_id, eviction_reason FROM candidates WHERE eviction_reason IS NOT NULL",
        "eviction_breakdown": f"WITH {SOURCES} SELECT kind, eviction_reason, count(*) AS n FROM candidates WHERE eviction_reason IS NOT NULL GROUP BY ALL",
        "evict_apply": f"WITH {SOURCES} SELECT source_id, chunk_count AS chunks FROM sources JOIN candidates USING (source_id) WHERE eviction_reason IS NULL",
        "kb_stats": f"WITH {SOURCES}{VOCAB.removeprefix(CHUNKS)} {_STATS} UNION ALL SELECT 'vocabulary', count(DISTINCT word) FROM vw",
        "sources_newest": f"WITH {BARE} SELECT source_id, label FROM bare ORDER BY source_id DESC LIMIT 100",
        "chunks_of_source": f"WITH {CHUNKS} SELECT chunk_no, title, sha256(content) AS content_sha FROM chunks WHERE source_id = 10",
        "section_inventory": f"WITH {CHUNKS} SELECT source_id, sha256(string_agg('- ' || title || ' (' || printf('%.1f', strlen(content) / 1024.0) || 'KB)', chr(10) ORDER BY chunk_no)) AS inventory_sha FROM chunks GROUP BY source_id",
        "retag_sources": f"WITH {BARE} SELECT ['execute:', 'file:', 'batch:', 'doc:'][source_id % 4 + 1] || source_id AS label, CASE WHEN source_id % 4 < 3 THEN 'ephemeral' ELSE kind END AS kind FROM bare",
        "exit_classes": """WITH r AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'shell' ELSE 'python' END AS language, CAST(event_id % 3 AS INTEGER) AS code, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'out' END AS stdout FROM events)
SELECT language, code, stdout, CASE WHEN code = 0 THEN 'ok' WHEN language = 'shell' AND code = 1 AND stdout = 'out' THEN 'soft_fail' ELSE 'fail' END AS class, count(*) AS n FROM r GROUP BY ALL""",
        "import_counts": f"WITH {ARCHIVE}, s AS (SELECT CASE conv_id % 4 WHEN 0 THEN 'new' WHEN 3 THEN 'updated' ELSE 'skipped' END AS status FROM archive) SELECT coalesce(status, 'total') AS status, count(*) AS n FROM s GROUP BY GROUPING SETS ((status), ())",
        "project_sessions": f"WITH {ARCHIVE} SELECT session, CASE WHEN conv_id % 3 = 1 THEN '/home/P1' ELSE '-home-P1' END AS project_path FROM archive WHERE conv_id % 7 = 1",
        "archive_import": f"""WITH {ROLES}, c AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS session, conv_id % 7 = 3 AS bad, conv_id % 7 = 3 AND conv_id % 2 = 1 AS lost FROM conversations),
m AS (SELECT session, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY line_no)) AS h FROM turns GROUP BY session)
SELECT session, CASE WHEN lost THEN 'no readable line' ELSE 'archived' END AS state, CASE WHEN lost THEN 0 ELSE coalesce(n, 0) END AS messages, CASE WHEN NOT lost THEN h END AS text_sha,
  CASE WHEN lost THEN NULL WHEN conv_id % 3 <> 2 AND NOT bad THEN '2024-03-15' ELSE '2024-03-16' END AS archived_at FROM c LEFT JOIN m USING (session)""",
        "project_paths": _PROJECT_PATHS,
        "vault_delete": f"WITH {ARCHIVE} SELECT session, message_count FROM archive WHERE conv_id <> 3",
        "line_for_row": "WITH c AS (SELECT DISTINCT conv_id FROM conversations), w AS (SELECT conv_id AS session, x AS row FROM c, unnest([0, 4, 10]) AS r(x)) SELECT w.session, CAST(w.row AS BIGINT) AS row, coalesce(max(k.turn), 0) AS line FROM w LEFT JOIN conversations k ON k.conv_id = w.session AND k.turn % 2 = 1 AND k.turn * 3 <= w.row GROUP BY ALL",
        "viewer_messages": f"""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS session, conv_id, turn, role, {trim("text")} AS t FROM conversations WHERE role <> 'system'),
m AS (SELECT session, conv_id, turn, role, 0 AS k, CASE role WHEN 'user' THEN t ELSE CASE WHEN t = '' THEN '' ELSE t || chr(10) END || '→ Grep' END AS body FROM c UNION ALL SELECT session, conv_id, turn, 'subagent', 1, 'task ' || turn FROM c WHERE role = 'assistant'),
a AS (SELECT conv_id, count(*) AS markers, count(*) FILTER (WHERE conv_id % 2 = 0 OR turn < 2) AS agents FROM c WHERE role = 'assistant' GROUP BY 1)
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY turn, k) - 1 AS INTEGER) AS no, CAST(turn AS INTEGER) AS line_no, role, sha256(body) AS body_sha, CASE WHEN role = 'subagent' AND markers = agents THEN printf('a%03d', turn) END AS agent_id, role = 'subagent' AND markers = agents AS openable FROM m LEFT JOIN a USING (conv_id) WHERE body <> ''""",
        "subagent_logs": f"WITH {PAIRS} SELECT 's' || (conv_id % 50) AS session, 'agent-' || conv_id AS agent_id, pair_no, sha256(human) AS human_sha, CASE WHEN conv_id % 2 = 0 THEN 'type' || (conv_id % 3) ELSE '' END AS agent_type, CASE WHEN conv_id % 2 = 0 THEN 'd' ELSE '' END AS agent_description FROM pairs",
        "session_labels": f"SELECT DISTINCT 'session:' || strftime({DAY0} + to_hours(CAST(conv_id AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') || ':' || conv_id AS label FROM conversations",
        "web_fetches": "WITH c AS (SELECT ['curl https://x.org', 'curl -o f https://x.org', 'ls; wget x.org/a', 'wget x.org > f', 'echo curly', 'python -c requests.get(1)'][event_id % 6 + 1] AS command, event_id % 6 IN (0, 2, 5) AS fetches FROM events) SELECT command, fetches, count(*) AS n FROM c GROUP BY ALL",
        "coerce_commands": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'cmd_1=ls ' || event_id || ';cmd_3=pwd' WHEN 1 THEN 'a=c' || event_id || ';cmd_3=d' WHEN 2 THEN 'cmd_1=x' || event_id END AS commands, CASE event_id % 5 WHEN 0 THEN 'ls ' || event_id WHEN 1 THEN '' WHEN 2 THEN 'x' || event_id END AS strings FROM events",
        "command_policy": """WITH c AS (SELECT ['git status', 'git push origin', 'ls', 'ls && rm -rf /', 'echo "a; rm b"', 'cat x | sudo tee y'][event_id % 6 + 1] AS command FROM events)
SELECT command, CASE command WHEN 'git push origin' THEN 'ask' WHEN 'git status' THEN 'allow' WHEN 'ls' THEN 'allow' WHEN 'echo "a; rm b"' THEN 'ask' ELSE 'deny' END AS decision,
  CASE command WHEN 'git push origin' THEN 'Bash(git push:*)' WHEN 'git status' THEN 'Bash(git:*)' WHEN 'ls' THEN 'Bash(ls)' WHEN 'ls && rm -rf /' THEN 'Bash(rm:*)' WHEN 'cat x | sudo tee y' THEN 'Bash(sudo *)' END AS pattern, count(*) AS n FROM c GROUP BY ALL""",
        "layer_checks": f"""WITH {_found()}, per AS (SELECT query_id, CASE WHEN count(*) > 0 THEN 'trigram' END AS layer, min(rank) FILTER (WHERE relevant) AS first FROM rel GROUP BY 1),
j AS (SELECT c.query_id, layer, coalesce(layer = CASE WHEN c.query_id % 4 = 0 THEN 'porter' ELSE 'trigram' END, false) AS layer_match, CAST(coalesce(first, 0) AS INTEGER) AS first, c.query_id % 3 AS ceiling FROM cases c LEFT JOIN per USING (query_id) WHERE needle IS NOT NULL)
SELECT query_id, layer_match, first, CASE WHEN ceiling > 0 THEN first > 0 AND first <= ceiling END AS ceiling_pass, CASE WHEN layer IS NULL THEN 'no_results' WHEN NOT layer_match THEN 'match_layer' WHEN ceiling > 0 AND NOT (first > 0 AND first <= ceiling) THEN 'rank_ceiling' END AS failure FROM j""",
        "context_reduction": f"WITH {_found()}, {_REDUCED} SELECT query_id, round(compression, 6) AS compression, round(recall, 6) AS recall, round(perfect, 6) AS perfect, round(effective, 6) AS effective FROM reduced",
        "reduction_summary": f"WITH {_found()}, {_REDUCED} SELECT coalesce(content_type, '(all)') AS content_type, round(avg(compression), 6) AS avg_compression_ratio, round(avg(recall), 6) AS avg_context_recall, round(avg(perfect), 6) AS perfect_recall_rate, round(avg(effective), 6) AS avg_effective_compression FROM reduced GROUP BY GROUPING SETS ((content_type), ())",
        "smart_truncate": """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE strlen(text) > 2000),
x AS (SELECT doc_id, i, l[i] AS line, strlen(l[i]) + 1 AS b, len(l) AS n FROM d, unnest(range(1, len(l) + 1)) AS r(i)), f AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM x),
a AS (SELECT doc_id, greatest(1, count(*) FILTER (WHERE c <= 1200)) AS front FROM f GROUP BY 1), g AS (SELECT f.*, front, sum(b) OVER (PARTITION BY doc_id ORDER BY i DESC) AS e FROM f JOIN a USING (doc_id)),
k AS (SELECT doc_id, front, any_value(n) AS n, CASE WHEN any_value(n) > front THEN greatest(1, count(*) FILTER (WHERE i > front AND e <= 800)) ELSE 0 END AS back FROM g GROUP BY doc_id, front),
z AS (SELECT doc_id, k.front, k.back, k.n, sum(b) FILTER (WHERE i <= k.front) AS fb, coalesce(sum(b) FILTER (WHERE i > k.n - k.back), 0) AS bb, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE i <= k.front) AS head, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE i > k.n - k.back), '') AS tail FROM g JOIN k USING (doc_id) GROUP BY ALL)
SELECT doc_id, sha256(head || chr(10) || chr(10) || '... [' || (n - front - back) || ' lines / ' || printf('%.1f', (strlen(text) - fb - bb) / 1024.0) || 'KB truncated — showing first ' || front || ' + last ' || back || ' lines] ...' || chr(10) || chr(10) || tail) AS cut_sha FROM z JOIN d USING (doc_id)""",
        "intent_summary": f"""WITH {VOCAB}, n AS (SELECT source_id, count(*) AS n FROM chunks GROUP BY 1), df AS (SELECT source_id, word, count(DISTINCT chunk_no) AS df FROM vw GROUP BY 1, 2),
s AS (SELECT source_id, word, ln(n / df) + least(strlen(word) / 20.0, 0.5) + CASE WHEN contains(word, '_') THEN 1.5 WHEN strlen(word) >= 12 THEN 0.8 ELSE 0 END AS score FROM df JOIN n USING (source_id) WHERE n >= 3 AND df >= 2 AND df <= greatest(3, ceil(n * 0.4))),
t AS (SELECT source_id, string_agg(word, ', ' ORDER BY score DESC, word) AS words FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, word) <= 5) x GROUP BY 1),
f AS (SELECT *, split_part(content, chr(10), 1) AS first_ FROM chunks WHERE contains(lower(content), 'license') QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY chunk_no) <= 3),
l AS (SELECT source_id, count(*) AS k, string_agg('  - ' || title || ': ' || {byte_prefix("first_", 120)}, chr(10) ORDER BY chunk_no) AS listed FROM f GROUP BY 1)
SELECT source_id, 'Indexed ' || n || ' sections from "doc:' || source_id || '" into knowledge base.' || chr(10) || coalesce(k, 0) || ' sections matched (' || len(string_split(text, chr(10))) || ' lines, ' || printf('%.1f', strlen(text) / 1024.0) || 'KB):' || chr(10) || chr(10) || coalesce(listed, '')
  || coalesce(chr(10) || chr(10) || 'Searchable terms: ' || words, '') AS summary FROM red JOIN n USING (source_id) LEFT JOIN l USING (source_id) LEFT JOIN t USING (source_id)""",
        "vault_search": f"""WITH {ROLES}, placed AS (SELECT *, row_number() OVER (PARTITION BY session, turn_index ORDER BY nth) - 1 AS message_index, {_tokens("text")} AS tk FROM turned),
c AS (SELECT count(*) AS total, avg(len(tk)) AS mean FROM placed), w AS (SELECT * FROM (VALUES ('the'), ('of')) v(term)), h AS (SELECT p.*, term, len(list_filter(tk, lambda x: x = term)) AS tf FROM placed p, w WHERE list_contains(tk, term)),
df AS (SELECT term, count(*) AS df FROM h GROUP BY 1), g AS (SELECT session, turn_index, message_index, role, text, sum(-(CASE WHEN ln((total - df + 0.5) / (df + 0.5)) > 0 THEN ln((total - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tk) / mean))) AS score, count(*) AS k FROM h JOIN df USING (term), c GROUP BY ALL),
b AS (SELECT *, regexp_split_to_array(text, '\\s+') AS p FROM g WHERE k = 2 ORDER BY score, session, turn_index, message_index LIMIT 20),
q AS (SELECT *, greatest(0, coalesce(list_min(list_filter(range(0, len(p)), lambda i: contains(lower(p[i + 1]), 'the') OR contains(lower(p[i + 1]), 'of'))), 0) - 8) AS st FROM b)
SELECT session, turn_index, role, round(score, 6) AS score, CASE WHEN st > 0 THEN '…' ELSE '' END || array_to_string(list_transform(p[st + 1:st + 16], lambda x: CASE WHEN contains(lower(x), 'the') OR contains(lower(x), 'of') THEN '[' || x || ']' ELSE x END), ' ') || CASE WHEN st + 16 < len(p) THEN '…' ELSE '' END AS snippet FROM q""",
        "vault_render": f"WITH {ROLES} SELECT session, string_agg('## ' || upper(left(role, 1)) || substr(role, 2) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY nth) AS text FROM turned GROUP BY session",
        "snippet_text": """WITH d AS (SELECT doc_id, text, length(text) AS n, lower(text) AS l FROM documents WHERE contains(lower(text), 'license')),
h AS (SELECT DISTINCT doc_id, i - 1 AS pos FROM d, unnest(range(1, n + 1)) AS r(i) WHERE substr(l, i, 7) = 'license' OR substr(l, i, 6) = 'apache'),
s AS (SELECT doc_id, pos, greatest(0, pos - 300) AS s, least(n, pos + 300) AS e FROM h JOIN d USING (doc_id)), m AS (SELECT *, CASE WHEN lag(e) OVER w IS NULL OR s > lag(e) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM m) x GROUP BY doc_id, isl), c AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i),
p AS (SELECT doc_id, string_agg(CASE WHEN s > 0 THEN '…' ELSE '' END || substr(text, s + 1, CAST(least(e - s, 400 - before) AS BIGINT)) || CASE WHEN e < n THEN '…' ELSE '' END, chr(10) || chr(10) ORDER BY s) AS t FROM c JOIN d USING (doc_id) WHERE before < 400 GROUP BY doc_id)
SELECT doc_id, CASE WHEN n <= 400 THEN text ELSE t END AS snippet FROM d LEFT JOIN p USING (doc_id)""",
        "kind_sizes": f"WITH {CHUNKS}, {BARE}, {_SIZES} SELECT kind, count(*) AS sources, CAST(sum(chunk_rows) AS BIGINT) AS chunks, CAST(sum(content_bytes) AS BIGINT) AS content_bytes FROM sized GROUP BY kind",
        "top_sources": f"WITH {CHUNKS}, {BARE}, {_SIZES} SELECT label, content_bytes, chunk_rows FROM sized ORDER BY content_bytes DESC, label LIMIT 15",
        "oversized": f"WITH {CHUNKS}, {BARE}, {_SIZES} SELECT source_id, content_bytes FROM sized WHERE content_bytes > 15000",
        "index_upsert_plan": f"WITH {BARE}, {INCOMING} SELECT label, action, seq FROM plan",
        "index_upsert_apply": f"""WITH {SOURCES}, {INCOMING}, top AS (SELECT max(source_id) AS top FROM bare)
SELECT s.source_id, s.label, CASE WHEN action = 'rekind' THEN p.kind ELSE s.kind END AS kind, s.content_hash, access_count FROM sources s LEFT JOIN plan p USING (label) WHERE action IS NULL OR action <> 'replace'
UNION ALL SELECT top + row_number() OVER (ORDER BY seq), label, kind, content_hash, 0 FROM plan, top WHERE action IN ('insert', 'replace')""",
        "fetch_cache_hits": f"WITH {BARE} SELECT label, (CASE WHEN source_id % 2 = 0 THEN kind ELSE 'ephemeral' END = kind) AND epoch({AS_OF}) - epoch(indexed_at) < 864000 AS hit FROM bare",
        "access_tracking": f"WITH {BARE}, l AS (SELECT DISTINCT event_id % 1000 AS s, user_id FROM events) SELECT source_id, count(user_id) AS access_count FROM bare LEFT JOIN l ON user_id = source_id GROUP BY source_id",
        "turn_pairs": f"WITH {PAIRS} SELECT session, pair_no, sha256(human) AS human_sha, sha256(assistant) AS assistant_sha FROM pairs",
        "session_indexable": f"WITH {PAIRS} SELECT session, count(*) AS pairs, CAST(sum(strlen(assistant)) AS BIGINT) AS assistant_bytes, count(*) >= 2 AND sum(strlen(assistant)) >= 200 AS indexable FROM pairs GROUP BY session",
        "transcript_render": f"WITH {PAIRS} SELECT session, count(*) AS pairs, sha256(string_agg(text, chr(10) ORDER BY pair_no)) AS transcript_sha FROM rendered GROUP BY session",
        "session_windows": f"WITH {WINDOWS} SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY first) - 1 AS INTEGER) AS chunk_no, sha256(content) AS content_sha FROM wins",
        "session_titles": f"WITH {WINDOWS} SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY first) - 1 AS INTEGER) AS chunk_no, 'Session ' || strftime({DAY0} + to_hours(CAST(conv_id AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') || ' | Turns ' || (first + 1) || '-' || (last + 1) AS title FROM wins",
        "subagent_blocks": f"""WITH {PAIRS}, both_ AS (SELECT session, pair_no, human, assistant, false AS sub, '' AS a FROM pairs WHERE pair_no < 1 UNION ALL SELECT session, pair_no, human, assistant, true, 'a' || (pair_no % 3) FROM pairs WHERE pair_no >= 1),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY sub, a, pair_no) AS no FROM both_), f AS (SELECT *, sub AND NOT coalesce(lag(sub) OVER w, false) AS opens, sub AND lead(sub) OVER w IS NULL AS closes FROM o WINDOW w AS (PARTITION BY session ORDER BY no)),
t AS (SELECT session, no, CASE WHEN opens THEN '--- Subagent: explore — "find \\"it\\"" ---' || chr(10) ELSE '' END || CASE WHEN NOT sub AND human = '' THEN '[Session summary: ' || assistant || ']' || chr(10) ELSE 'Human: ' || human || chr(10) || 'Assistant: ' || assistant || chr(10) END || CASE WHEN closes THEN '--- End subagent ---' || chr(10) ELSE '' END AS text FROM f)
SELECT session, count(*) AS pairs, sha256(string_agg(text, chr(10) ORDER BY no)) AS transcript_sha FROM t GROUP BY session""",
        "session_log_pairs": f"WITH {PAIRS}, t AS (SELECT session, island, count(*) FILTER (WHERE role = 'assistant') AS tools FROM isl GROUP BY ALL), p2 AS (SELECT g.session, g.island, CAST(row_number() OVER (PARTITION BY g.session ORDER BY g.island) - 1 AS INTEGER) AS pair_no, CASE first WHEN 'away_summary' THEN '' ELSE human END AS human, CASE first WHEN 'away_summary' THEN 0 ELSE tools END AS tools FROM grp g JOIN t ON t.session = g.session AND t.island = g.island WHERE first = 'away_summary' OR assistant <> '') SELECT session, pair_no, sha256(human) AS human_sha, CAST(tools AS INTEGER) AS tools FROM p2",
        "vault_messages": f"WITH {ROLES} SELECT session, turn_index, CAST(row_number() OVER (PARTITION BY session, turn_index ORDER BY nth) - 1 AS INTEGER) AS message_index, line_no, role, sha256(text) AS text_sha FROM turned",
        "vault_import_status": f"WITH {ARCHIVE} SELECT CASE WHEN conv_id % 4 = 0 THEN 'n' ELSE '' END || session AS session, CASE conv_id % 4 WHEN 0 THEN 'new' WHEN 3 THEN 'updated' ELSE 'skipped' END AS status FROM archive",
        "vault_stats": f"WITH {ARCHIVE} SELECT count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) FILTER (WHERE machine_id <> 'm0') AS other_machines, strftime(min(start_time), '%Y-%m-%d %H:%M:%S') AS first_start, strftime(max(end_time), '%Y-%m-%d %H:%M:%S') AS last_end FROM archive",
        "vault_projects": f"WITH {ARCHIVE} SELECT project_path, count(*) AS sessions FROM archive GROUP BY project_path",
        "vault_list": f"WITH {ARCHIVE} SELECT session, project_path, message_count FROM archive WHERE project_path ILIKE '%/P1%' AND end_time >= {DAY0} AND end_time <= TIMESTAMP '2024-01-02 23:59:59'",
        "uuid_prefix_lookup": f"WITH {ARCHIVE} SELECT session, count(*) OVER () > 1 AS ambiguous FROM archive WHERE starts_with(session, '00000001')",
        "asof_message": "WITH c AS (SELECT DISTINCT conv_id FROM conversations), w AS (SELECT conv_id AS session, x AS line FROM c, unnest([0, 2, 9]) AS r(x)) SELECT w.session, CAST(line AS BIGINT) AS line, CAST(greatest(0, count(k.turn) - 1) AS INTEGER) AS message FROM w LEFT JOIN conversations k ON k.conv_id = w.session AND k.turn % 2 = 1 AND k.turn <= line GROUP BY ALL",
        "search_throttle": _THROTTLE,
        "throttle_stream": _THROTTLE,
        "expiry_stream": f"WITH {BARE}, due AS (SELECT label, kind, indexed_at + CASE kind WHEN 'ephemeral' THEN INTERVAL 1 DAY ELSE INTERVAL 60 DAY END AS at_ FROM bare WHERE kind <> 'durable') SELECT label, kind, strftime(at_, '%Y-%m-%d %H:%M:%S') AS expired_at FROM due WHERE at_ < (SELECT max(indexed_at) FROM bare)",
        "debounce_latest": "WITH e AS (SELECT DISTINCT user_id AS client, ts FROM events), g AS (SELECT client, epoch_us(lead(ts) OVER (PARTITION BY client ORDER BY ts)) - epoch_us(ts) AS gap FROM e) SELECT client, count(*) AS n FROM g WHERE gap IS NULL OR gap > 600000000 GROUP BY client",
        "guidance_once": "SELECT user_id AS client, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
        "tool_stats": """WITH c AS (SELECT event_type AS tool, strlen(props) * 100 AS r, strlen(props) * 7 AS s FROM events), g AS (SELECT coalesce(tool, '(all)') AS tool, count(*) AS calls, CAST(sum(r) AS BIGINT) AS raw_bytes, CAST(sum(s) AS BIGINT) AS shown_bytes FROM c GROUP BY GROUPING SETS ((tool), ()))
SELECT *, CAST(floor(shown_bytes / 4) AS BIGINT) AS tokens, round(raw_bytes / greatest(shown_bytes, 1), 6) AS ratio, round(CASE WHEN raw_bytes > 0 THEN 100.0 * (1 - shown_bytes / raw_bytes) ELSE 0 END, 6) AS reduction FROM g""",
        "sweep_status": "WITH c AS (SELECT DISTINCT conv_id AS n FROM conversations) SELECT CASE WHEN n % 4 = 0 THEN 'new' WHEN n % 4 = 1 OR n % 3 = 0 THEN 'changed' ELSE 'current' END AS status, count(*) AS n FROM c GROUP BY 1",
        "git_url_parse": """WITH p AS (SELECT page_id, page_id % 6 AS f, CAST(page_id % 10 AS VARCHAR) AS a, CAST(page_id AS VARCHAR) AS b FROM pages)
SELECT page_id, ['github.com', 'github.com', 'gitlab.example.com', 'codeberg.org', '', 'bitbucket.org'][f + 1] AS host, CASE WHEN f < 2 THEN 'o' || a ELSE '' END AS owner, CASE WHEN f < 2 THEN 'r' ELSE '' END AS repo, b AS number,
  ['issue', 'pr', 'mr', 'pr', '', 'pr'][f + 1] AS kind, CASE f WHEN 0 THEN 'gh issue view ' || b || ' --repo o' || a || '/r' WHEN 1 THEN 'gh pr view ' || b || ' --repo o' || a || '/r' ELSE '' END AS hint FROM p WHERE f <> 4""",
        "private_host": """WITH i AS (SELECT c_custkey, [10, 127, 172, 192, 169, 8, 224][c_custkey % 7 + 1] AS a, CASE c_custkey % 3 WHEN 0 THEN 168 WHEN 1 THEN 254 ELSE c_custkey % 40 END AS b, c_custkey % 250 AS c FROM customer)
SELECT c_custkey, a IN (10, 127) OR a = 192 AND b = 168 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 169 AND b = 254 OR a = 224 AND b = 0 AND c = 0 AS private FROM i""",
        "binary_detect": "SELECT page_id, CASE page_id % 5 WHEN 1 THEN true WHEN 4 THEN true WHEN 0 THEN false ELSE page_id % 2 = 1 OR strlen(html) < 512 END AS is_binary FROM pages",
        "path_policy": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '**/.env' WHEN event_id % 7 = 3 THEN 'src/a3/**' END AS denied_by FROM events",
        "shell_extract": "SELECT event_id, 'rm ' || event_id || '|x ' || event_id || '|ls -l' AS commands FROM events",
        "needle_containment": f"WITH {_found()} SELECT query_id, CAST(rank AS INTEGER) AS rank, relevant FROM rel",
        "niah_metrics": f"WITH {_found()} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in catalogue.NAMES)}, false_positive FROM metrics",
        "niah_summary": f"""WITH {_found()} SELECT coalesce(content_type, '(all)') AS content_type, round(avg(recall_at_10) FILTER (WHERE needle IS NOT NULL), 6) AS recall_at_10, round(avg(mrr) FILTER (WHERE needle IS NOT NULL), 6) AS mrr, round(avg(context_recall) FILTER (WHERE needle IS NOT NULL), 6) AS avg_context_recall, round(avg(context_recall), 6) AS avg_context_recall_all,
count(*) FILTER (WHERE needle IS NOT NULL) AS case_count, count(*) FILTER (WHERE needle IS NULL) AS negative_case_count FROM metrics GROUP BY GROUPING SETS ((content_type), ())""",
        "report_compare": f"""WITH {_found()}, long AS (UNPIVOT (SELECT query_id, content_type, recall_at_10 + 0.0 AS recall_at_10, mrr + 0.0 AS mrr, context_recall + 0.0 AS avg_context_recall FROM metrics) ON recall_at_10, mrr, avg_context_recall INTO NAME metric VALUE v),
s AS (SELECT content_type, metric, coalesce(avg(v) FILTER (WHERE query_id % 2 = 1), 0) - coalesce(avg(v) FILTER (WHERE query_id % 2 = 0), 0) AS delta FROM long GROUP BY ALL)
SELECT content_type, metric, round(delta, 6) AS delta, delta < CASE WHEN metric = 'avg_context_recall' THEN 0 ELSE -0.02 END - 1e-4 AND abs(delta) >= 1e-4 AS regression FROM s""",
        "failure_diff": "WITH o AS (SELECT o_custkey AS case_id, o_orderstatus AS type, bool_or(o_orderkey % 2 = 0) AS b, bool_or(o_orderkey % 2 = 1) AS t FROM orders GROUP BY ALL) SELECT case_id, type, CASE WHEN t THEN 'new' ELSE 'resolved' END AS change FROM o WHERE b <> t",
        "output_budget": "WITH s AS (SELECT doc_id % 20 AS request, doc_id AS query_no, coalesce(sum(strlen(text)) OVER (PARTITION BY doc_id % 20 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT request, query_no FROM s WHERE before < 40960",
        "edit_distance": "SELECT c_custkey, CAST(levenshtein(lower(c_name), 'cüstomer#00000042') AS INTEGER) AS d FROM customer",
        "composite_hash": "SELECT conv_id AS session, sha256(unhex(string_agg(lpad(printf('%x', CAST(4 AS BIGINT)), 16, '0') || hex(encode(printf('f%03d', turn))) || lpad(printf('%x', CAST(strlen(text) AS BIGINT)), 16, '0') || hex(encode(text)), '' ORDER BY turn))) AS content_hash, CAST(sum(strlen(text)) AS BIGINT) AS size_bytes FROM conversations GROUP BY conv_id",
        "line_scan": "WITH l AS (SELECT doc_id, string_split(replace(text, chr(10), chr(13) || chr(10) || chr(10)), chr(10)) AS l FROM documents), e AS (SELECT doc_id, i - 1 AS line_no, regexp_replace(l[i], '\\r$', '') AS line, strlen(l[i]) AS b, i = len(l) AS last FROM l, unnest(range(1, len(l) + 1)) AS r(i)) SELECT doc_id, count(*) AS lines, CAST(max(line_no) AS INTEGER) AS last_line FROM e WHERE b <= 5000 AND line <> '' GROUP BY doc_id",
    }
