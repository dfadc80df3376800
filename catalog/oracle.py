"""The registered queries in plain SQL, from the raw tables.

Written apart from the Spark code and step by step: tokens are cut one by one,
graphs come from window functions, distances from comparing all pairs of patterns
by transitive closure, classification from all pairs of documents and topics.
"""

from __future__ import annotations

from catalog.settings import Settings

# What a normalised document leaves out and needs, and the wording of the
# reports. Written out here so that a wrong constant in the engine shows.
MIN_TOKENS = 20
SPECIAL_TOKENS = [
    " ", ";", "/", ".", ",", '"', "\t", "#", "\u00a0", "(", ")", "[", "]", "!", "?",
    "'", ":", "&", "=", "-", "<", ">", "–", "{", "}", "\\", "...", "*", "+", "$", "@",
    "\u00a9", "\u00d7", "\u00ae", "\u00ad", "\u2028", "\u0323", "\u0300", "\u0301",
    "\u0302", "\u0303", "\u0309", "”", "“", '",', '":', ":/", '">', '=""', '="">',
    '="', '".', '?"', "=”", "=“", "”,", "”.", "“,", "“.", "〞,", "〞.", "〝,", "〝.",
    "?”.", "://", "_", "…", "’", "--",
]
REPORT_TOTAL = "%d đồ thị con phổ biến."
REPORT_N_VERTICES = "Trong đó có %d đỉnh phổ biến."
REPORT_N_GRAPHS = "Và %d đồ thị con phổ biến được tạo thành từ ít nhất một cạnh."
REPORT_VERTICES_TITLE = "Các đỉnh phổ biến là:"
REPORT_GRAPHS_TITLE = "Các đồ thị con phổ biến là:"
REPORT_GRAPH_TITLE = "Đồ thị con số %d:"
REPORT_SUPPORT = "Với độ phổ biến là: %d"


def _string(s: str) -> str:
    plain = all(c.isprintable() for c in s)
    return "'" + s.replace("'", "''") + "'" if plain else " || ".join(f"chr({ord(c)})" for c in s)


def _strings(values) -> str:
    return ", ".join(_string(v) for v in values)


def oracles(s: Settings = Settings()) -> dict[str, str]:
    """SQL text per query name."""
    parts: dict[str, str] = {}
    needs: dict[str, list[str]] = {}

    def part(name: str, sql: str, *used: str) -> None:
        parts[name], needs[name] = sql, list(used)

    def build(select: str, *used: str) -> str:
        order: list[str] = []

        def add(name: str) -> None:
            for other in needs[name]:
                add(other)
            if name not in order:
                order.append(name)

        for name in used:
            add(name)
        ctes = ",\n".join(f"{n} AS ({parts[n]})" for n in order)
        return f"WITH RECURSIVE {ctes}\n{select}" if order else select

    def normalisation(prefix: str, source: str) -> None:
        """CTEs from ``source(topic, doc_id, text)`` to tokens in document order."""
        p = prefix
        part(f"{p}lines", f"""
            SELECT topic, doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS ln
            FROM (SELECT topic, doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS ls FROM {source})""", source)
        part(f"{p}clean", f"""
            SELECT topic, doc_id, ln,
                   regexp_replace(lower(raw), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS line
            FROM {p}lines""", f"{p}lines")
        part(f"{p}words", f"""
            SELECT topic, doc_id, ln, wn, word FROM (
              SELECT topic, doc_id, ln, unnest(ws) AS word, unnest(range(len(ws))) AS wn
              FROM (SELECT topic, doc_id, ln, string_split(line, ' ') AS ws FROM {p}clean))
            WHERE word <> ''""", f"{p}clean")
        part(f"{p}head", f"""
            SELECT topic, doc_id, ln, wn,
                   CASE WHEN left(w, 1) IN ('"', '''', '(', '<', '#', '.', '”', '“') THEN substr(w, 2) ELSE w END AS w
            FROM (SELECT topic, doc_id, ln, wn,
                         CASE WHEN left(word, 2) IN ('</', '&#') THEN substr(word, 3) ELSE word END AS w
                  FROM {p}words WHERE length(word) > 1)""", f"{p}words")
        part(f"{p}cut", f"""
            SELECT topic, doc_id, ln, wn, w AS word FROM (
              SELECT topic, doc_id, ln, wn,
                     CASE WHEN right(w, 1) IN ('"', '''', ')', '>', ',', '.', '?', '!', ';', '”', '“')
                          THEN left(w, length(w) - 1) ELSE w END AS w
              FROM (SELECT topic, doc_id, ln, wn,
                           CASE WHEN right(w, 2) IN (',"', '>,', '.,', '.>', '."', '),')
                                THEN left(w, length(w) - 2) ELSE w END AS w
                    FROM {p}head))
            WHERE w <> ''""", f"{p}head")
        part(f"{p}kept", f"""
            SELECT topic, doc_id, word AS tok,
                   row_number() OVER (PARTITION BY topic, doc_id ORDER BY ln, wn) - 1 AS pos
            FROM {p}cut
            WHERE word NOT IN ({_strings(SPECIAL_TOKENS)}) AND word NOT IN ({_strings(s.stopwords)})""", f"{p}cut")

    def corpus_of(prefix: str, minimum: int) -> None:
        p = prefix
        part(f"{p}toks", f"""
            SELECT * FROM (SELECT topic, doc_id, pos, tok,
                                  count(*) OVER (PARTITION BY topic, doc_id) AS n FROM {p}kept)
            WHERE n >= {minimum}""", f"{p}kept")
        part(f"{p}corpus", f"SELECT DISTINCT topic, doc_id, n FROM {p}toks", f"{p}toks")
        part(f"{p}pairs", f"""
            SELECT topic, doc_id, pos, tok AS src, lead(tok) OVER (PARTITION BY topic, doc_id ORDER BY pos) AS dst
            FROM {p}toks""", f"{p}toks")
        part(f"{p}e", f"""
            SELECT DISTINCT topic, doc_id, src, dst FROM {p}pairs
            WHERE dst IS NOT NULL AND NOT (pos = 0 AND src = dst)""", f"{p}pairs")
        part(f"{p}v", f"SELECT DISTINCT topic, doc_id, tok AS v FROM {p}toks WHERE n >= 2", f"{p}toks")

    def mining_of(prefix: str, support: float) -> None:
        p = prefix
        part(f"{p}counts", f"""
            SELECT topic, count(*) AS n_graphs, CAST(ceil(count(*)::DOUBLE * {support!r}::DOUBLE) AS BIGINT) AS min_sup
            FROM {p}corpus GROUP BY topic""", f"{p}corpus")
        part(f"{p}ranks", f"""
            SELECT topic, v, df, row_number() OVER (PARTITION BY topic ORDER BY df DESC, v) - 1 AS rank
            FROM (SELECT topic, v, count(*) AS df FROM {p}v GROUP BY topic, v) JOIN {p}counts USING (topic)
            WHERE df >= min_sup""", f"{p}v", f"{p}counts")
        part(f"{p}rel", f"""
            SELECT e.topic, e.doc_id, x.rank AS a, y.rank AS b FROM {p}e e
            JOIN {p}ranks x ON x.topic = e.topic AND x.v = e.src
            JOIN {p}ranks y ON y.topic = e.topic AND y.v = e.dst""", f"{p}e", f"{p}ranks")
        part(f"{p}fe", f"""
            SELECT topic, a, b, support, n_graphs, min_sup
            FROM (SELECT topic, a, b, count(*) AS support FROM {p}rel GROUP BY topic, a, b)
            JOIN {p}counts USING (topic) WHERE support >= min_sup""", f"{p}rel", f"{p}counts")
        part(f"{p}de", f"SELECT rel.* FROM {p}rel rel SEMI JOIN {p}fe USING (topic, a, b)", f"{p}rel", f"{p}fe")
        # One row per pattern and document while growing: the path from the root
        # to the newest vertex is kept as parallel lists of pattern vertices (pi)
        # and ranks (pl).
        part(f"{p}grow", f"""
            SELECT topic, min_sup, [{{'i': 0, 'j': 1, 'a': a, 'b': b}}] AS code, [a, b] AS labels,
                   [0, 1]::INTEGER[] AS pi, [a, b] AS pl, -1 AS bound, list(doc_id) AS docs
            FROM {p}de JOIN {p}fe USING (topic, a, b) WHERE n_graphs > 1
            GROUP BY topic, min_sup, a, b
            UNION ALL
            SELECT topic, min_sup, list_append(code, {{'i': i, 'j': j, 'a': a, 'b': b}}) AS code,
                   CASE WHEN fwd THEN list_append(labels, b) ELSE labels END AS labels,
                   CASE WHEN fwd THEN list_append(pi[1:k], j) ELSE pi END AS pi,
                   CASE WHEN fwd THEN list_append(pl[1:k], b) ELSE pl END AS pl,
                   CASE WHEN fwd THEN -1 ELSE j END AS bound, docs
            FROM (
              SELECT topic, min_sup, code, labels, pi, pl, bound, k, pi[k] AS i, a, b, fwd,
                     CASE WHEN fwd THEN len(labels)::INTEGER ELSE pi[w] END AS j, list(doc_id) AS docs
              FROM (
                SELECT g.*, e.a, e.b, e.doc_id, list_position(g.pl, e.b) AS w, NOT list_contains(g.labels, e.b) AS fwd
                FROM (SELECT topic, min_sup, code, labels, pi, pl, bound, unnest(docs) AS doc_id, k
                      FROM (SELECT *, unnest(range(1, len(pl) + 1)) AS k FROM {p}grow
                            WHERE code[1].a <> code[1].b)) g
                JOIN {p}de e ON e.topic = g.topic AND e.doc_id = g.doc_id AND e.a = g.pl[g.k])
              WHERE (fwd AND (k = 1 OR a > pl[1]) AND (k = len(pl) OR b > pl[k + 1]))
                 OR (NOT fwd AND k = len(pl) AND w IS NOT NULL AND w <= len(pl) - 2 AND pi[w] > bound AND a > pl[1]
                     AND list_filter(code, lambda c: c.i = pi[w] AND c.i < c.j)[1].b <= a)
              GROUP BY ALL
              HAVING count(*) >= min_sup)""", f"{p}de", f"{p}fe")
        part(f"{p}pat", f"""
            SELECT topic, code, docs, len(code) AS n_edges, len(docs) AS support,
                   array_to_string(list_transform(code, lambda c: c.i || '-' || c.j || ':' || c.a || '>' || c.b), ',')
                     AS pattern_id,
                   row_number() OVER (PARTITION BY topic ORDER BY list_transform(code, lambda c:
                     {{'f': (c.i < c.j)::INTEGER, 'p': CASE WHEN c.i < c.j THEN -c.i ELSE c.j END, 'a': c.a, 'b': c.b}}))
                     - 1 AS graph_no
            FROM {p}grow""", f"{p}grow")

    part("src", "SELECT lang AS topic, doc_id, text FROM documents")
    normalisation("", "src")
    corpus_of("", MIN_TOKENS)
    mining_of("", s.min_support)
    part("folder_src", "SELECT source AS topic, doc_id, text FROM documents")
    normalisation("folder_", "folder_src")
    corpus_of("folder_", MIN_TOKENS)
    mining_of("folder_", s.min_support)
    part("new_src", "SELECT '' AS topic, item_id AS doc_id, text FROM benchmark")
    normalisation("new_", "new_src")
    corpus_of("new_", 0)

    part("steps", """
        SELECT topic, pattern_id, pos, x.v AS src, y.v AS dst
        FROM (SELECT topic, pattern_id, unnest(code) AS c, unnest(range(len(code))) AS pos FROM pat) q
        JOIN ranks x USING (topic) JOIN ranks y USING (topic)
        WHERE x.rank = q.c.a AND y.rank = q.c.b""", "pat", "ranks")
    part("pe", "SELECT topic, pattern_id, src, dst FROM steps WHERE src <> dst", "steps")
    part("pv", """SELECT topic, pattern_id, src AS v FROM steps
                  UNION SELECT topic, pattern_id, dst FROM steps""", "steps")
    part("psize", """
        SELECT topic, pattern_id, count(*) + coalesce(any_value(n_e), 0) AS size
        FROM pv LEFT JOIN (SELECT topic, pattern_id, count(*) AS n_e FROM pe GROUP BY ALL) USING (topic, pattern_id)
        GROUP BY ALL""", "pv", "pe")
    # All pairs of patterns of different topics with a common edge, the closure of
    # their common edges, and the largest component.
    part("ce", """
        SELECT x.topic AS tx, x.pattern_id AS px, y.topic AS ty, y.pattern_id AS py, src, dst
        FROM pe x JOIN pe y USING (src, dst) WHERE x.topic <> y.topic""", "pe")
    part("reach", """
        SELECT tx, px, ty, py, src AS root, src AS v FROM ce
        UNION
        SELECT r.tx, r.px, r.ty, r.py, r.root, CASE WHEN c.src = r.v THEN c.dst ELSE c.src END
        FROM reach r JOIN ce c ON c.tx = r.tx AND c.px = r.px AND c.ty = r.ty AND c.py = r.py
                              AND (c.src = r.v OR c.dst = r.v)""", "ce")
    part("mcs_e", """
        SELECT tx, px, ty, py, max(n_v + n_e) AS mcs FROM (
          SELECT r.tx, r.px, r.ty, r.py, r.root, count(DISTINCT r.v) AS n_v,
                 count(DISTINCT CASE WHEN c.src IS NOT NULL THEN {'s': c.src, 'd': c.dst} END) AS n_e
          FROM reach r LEFT JOIN ce c ON c.tx = r.tx AND c.px = r.px AND c.ty = r.ty AND c.py = r.py AND c.src = r.v
          GROUP BY ALL)
        GROUP BY ALL""", "reach")
    part("mcs_v", """
        SELECT DISTINCT x.topic AS tx, x.pattern_id AS px, y.topic AS ty, y.pattern_id AS py
        FROM pv x JOIN pv y USING (v) WHERE x.topic <> y.topic""", "pv")
    part("dist", """
        SELECT tx, px, ty, py, sx.size AS size_x, sy.size AS size_y, coalesce(mcs, 1) AS mcs,
               1.0::DOUBLE - coalesce(mcs, 1)::DOUBLE / greatest(sx.size, sy.size)::DOUBLE AS distance
        FROM mcs_v LEFT JOIN mcs_e USING (tx, px, ty, py)
        JOIN psize sx ON sx.topic = tx AND sx.pattern_id = px
        JOIN psize sy ON sy.topic = ty AND sy.pattern_id = py""", "mcs_v", "mcs_e", "psize")
    part("near", """
        SELECT topic, pattern_id, coalesce(distance, 1.0::DOUBLE) AS distance, ty AS near_topic, py AS near_pattern_id,
               mcs, size_x, size_y
        FROM pat LEFT JOIN (
          SELECT * FROM dist
          QUALIFY row_number() OVER (PARTITION BY tx, px ORDER BY distance, size_y, ty, py) = 1
        ) ON tx = topic AND px = pattern_id""", "pat", "dist")
    part("uniq", "SELECT r.topic, r.v, df, rank FROM ranks r JOIN "
                 "(SELECT v FROM ranks GROUP BY v HAVING count(*) = 1) USING (v)", "ranks")
    part("keptg", f"""
        SELECT p.topic, p.pattern_id, p.code, p.support, near.distance
        FROM pat p JOIN near USING (topic, pattern_id) WHERE near.distance > {s.min_distance!r}::DOUBLE""", "pat", "near")
    part("tids", "SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS topic_id FROM counts", "counts")
    part("budget", f"""
        SELECT u.topic, u.v, u.df, u.rank FROM uniq u
        LEFT JOIN (SELECT topic, count(*) AS n_g FROM keptg GROUP BY topic) USING (topic)
        QUALIFY row_number() OVER (PARTITION BY u.topic ORDER BY df DESC, v)
                <= greatest(0, {s.word_budget} - coalesce(n_g, 0))""", "uniq", "keptg")
    part("dims", """
        SELECT row_number() OVER (ORDER BY topic_id, kind DESC, rank, graph_no) - 1 AS dim_id, topic_id, topic, kind, label
        FROM (SELECT topic, 'word' AS kind, v AS label, rank, 0 AS graph_no FROM uniq
              UNION ALL
              SELECT k.topic, 'graph', k.pattern_id, 0, p.graph_no
              FROM keptg k JOIN pat p USING (topic, pattern_id)) JOIN tids USING (topic)""", "uniq", "keptg", "pat", "tids")
    part("els", """
        SELECT dim_id, topic_id, label AS x, NULL AS y FROM dims WHERE kind = 'word'
        UNION ALL
        SELECT dim_id, topic_id, src, dst FROM dims d JOIN pe ON pe.topic = d.topic AND pe.pattern_id = d.label
        WHERE kind = 'graph'
        UNION ALL
        SELECT dim_id, topic_id, v, NULL FROM dims d JOIN pv ON pv.topic = d.topic AND pv.pattern_id = d.label
        WHERE kind = 'graph' AND NOT EXISTS (
          SELECT 1 FROM pe WHERE pe.topic = d.topic AND pe.pattern_id = d.label)""", "dims", "pe", "pv")
    part("nels", "SELECT dim_id, topic_id, count(*) AS n_elements FROM els GROUP BY ALL", "els")
    part("tvec", "SELECT topic_id, min(dim_id) AS first_dim, count(*) AS n_dims FROM dims GROUP BY topic_id", "dims")

    def discovery_of(prefix: str) -> None:
        p = prefix
        part(f"{p}dd", f"""
            SELECT doc_id, dim_id, topic_id FROM (
              SELECT v.doc_id, x.dim_id FROM {p}v v JOIN els x ON x.y IS NULL AND x.x = v.v
              UNION ALL
              SELECT e.doc_id, x.dim_id FROM {p}e e JOIN els x ON x.x = e.src AND x.y = e.dst)
            JOIN nels USING (dim_id)
            GROUP BY doc_id, dim_id, topic_id, n_elements HAVING count(*) = n_elements""", f"{p}v", f"{p}e", "els", "nels")
        part(f"{p}scores", f"""
            SELECT d.doc_id, t.topic_id, t.n_dims AS n_topic, coalesce(o.n, 0) AS n_doc, coalesce(h.n, 0) AS n_shared,
                   sqrt((t.n_dims + coalesce(o.n, 0) - 2 * coalesce(h.n, 0))::DOUBLE) AS distance
            FROM {p}all_docs d CROSS JOIN tvec t
            LEFT JOIN (SELECT doc_id, count(*) AS n FROM {p}dd GROUP BY ALL) o ON o.doc_id = d.doc_id
            LEFT JOIN (SELECT doc_id, topic_id, count(*) AS n FROM {p}dd GROUP BY ALL) h
                   ON h.doc_id = d.doc_id AND h.topic_id = t.topic_id""", f"{p}all_docs", "tvec", f"{p}dd")
        part(f"{p}best", f"""
            SELECT doc_id, topic_id FROM {p}scores
            QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY n_topic + n_doc - 2 * n_shared) = 1""", f"{p}scores")

    part("all_docs", "SELECT doc_id FROM corpus", "corpus")
    part("new_all_docs", "SELECT doc_id FROM new_src", "new_src")
    discovery_of("")
    discovery_of("new_")

    fmt = lambda text, *args: "printf(" + ", ".join([_string(text), *args]) + ")"
    part("matrix", """
        SELECT v.topic, v.doc_id, v.v, v.v || ' ==> ' || coalesce(string_agg(dst, ', ' ORDER BY dst), '{}') AS line
        FROM v LEFT JOIN e ON e.topic = v.topic AND e.doc_id = v.doc_id AND e.src = v.v
        GROUP BY v.topic, v.doc_id, v.v""", "v", "e")
    part("paths", """
        SELECT topic, pattern_id, string_agg(CASE WHEN pos > 0 AND src = prev THEN ' ==> ' || dst
                                                  WHEN pos > 0 THEN ', ' || src || ' ==> ' || dst
                                                  ELSE src || ' ==> ' || dst END, '' ORDER BY pos) AS path
        FROM (SELECT *, lag(dst) OVER (PARTITION BY topic, pattern_id ORDER BY pos) AS prev FROM steps)
        GROUP BY ALL""", "steps")
    part("pmatrix", """
        SELECT pv.topic, pv.pattern_id, pv.v, pv.v || ' ==> ' || coalesce(string_agg(dst, ', ' ORDER BY dst), '{}') AS line
        FROM pv LEFT JOIN pe ON pe.topic = pv.topic AND pe.pattern_id = pv.pattern_id AND pe.src = pv.v
        GROUP BY pv.topic, pv.pattern_id, pv.v""", "pv", "pe")

    def report(totals: str, words: str, graphs: str, full: str, with_graphs: str, bodies: str) -> str:
        return f"""
        SELECT topic, section::BIGINT AS section, place::BIGINT AS place, part::BIGINT AS part, line FROM (
          SELECT topic, 0 AS section, unnest(range(len(head))) AS place, 0 AS part, unnest(head) AS line FROM (
            SELECT topic, list_filter([{fmt(REPORT_TOTAL, 'n_w + n_p')},
              CASE WHEN {full} THEN {fmt(REPORT_N_VERTICES, 'n_w')} END,
              CASE WHEN {full} AND {with_graphs} THEN {fmt(REPORT_N_GRAPHS, 'n_p')} END,
              CASE WHEN {full} THEN {_string(REPORT_VERTICES_TITLE)} END], lambda x: x IS NOT NULL) AS head
            FROM {totals})
          UNION ALL SELECT topic, 1, rank, 0, v || ' :: ' || df FROM {words}
          UNION ALL SELECT topic, 2, 0, 0, {_string(REPORT_GRAPHS_TITLE)} FROM {totals} WHERE n_p > 0
          UNION ALL SELECT topic, 3, graph_no, 0, {fmt(REPORT_GRAPH_TITLE, 'graph_no')} FROM {graphs}
          UNION ALL {bodies})"""

    part("totals", """
        SELECT c.topic, (SELECT count(*) FROM ranks r WHERE r.topic = c.topic) AS n_w,
               (SELECT count(*) FROM pat p WHERE p.topic = c.topic) AS n_p FROM counts c""", "counts", "ranks", "pat")
    part("ctotals", """
        SELECT c.topic, (SELECT count(*) FROM uniq u WHERE u.topic = c.topic) AS n_w,
               (SELECT count(*) FROM keptg k WHERE k.topic = c.topic) AS n_p FROM counts c""", "counts", "uniq", "keptg")
    part("cgraphs", """
        SELECT pat.topic, pat.pattern_id, row_number() OVER (PARTITION BY pat.topic ORDER BY pat.graph_no) - 1 AS graph_no
        FROM keptg JOIN pat USING (topic, pattern_id)""", "keptg", "pat")
    part("cmatrix", """
        SELECT m.topic, g.graph_no, m.line, row_number() OVER (ORDER BY m.topic, g.graph_no, m.v) - 1 AS position
        FROM pmatrix m JOIN cgraphs g USING (topic, pattern_id)""", "pmatrix", "cgraphs")

    token_counts = "SELECT topic, tok AS token, count(*) AS n FROM kept GROUP BY ALL"
    file_hashes = """
        SELECT topic, content_hash, max(n_tokens) AS n_tokens, count(*) AS n FROM (
          SELECT topic, doc_id, md5(string_agg(tok, chr(10) ORDER BY pos)) AS content_hash, count(*) AS n_tokens"""
    patterns_sql = "SELECT topic, pattern_id, n_edges::BIGINT AS n_edges, support::BIGINT AS support FROM {p}pat"
    vec = lambda body, sep: f"array_to_string(list_transform(range({body[0]}), lambda d: {body[1]}), '{sep}')"

    return {
        "text_lines": build("""
            SELECT topic, doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
            FROM clean GROUP BY ALL""", "clean"),
        "raw_words": build("SELECT topic, word, count(*) AS n FROM words GROUP BY ALL", "words"),
        "trimmed_words": build("SELECT topic, word, count(*) AS n FROM cut GROUP BY ALL", "cut"),
        "tokens": build(token_counts, "kept"),
        "tokens_by_stopword_table": build(token_counts, "kept"),
        "stopword_file": build(f"""
            SELECT topic, word, count(*) AS n FROM cut WHERE word IN ({_strings(s.stopwords)}) GROUP BY ALL""", "cut"),
        "corpus_stats": build("""
            SELECT topic, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM corpus GROUP BY ALL""", "corpus"),
        "normalised_corpus": build("""
            SELECT topic, doc_id, 'documents/' || doc_id AS orgpath, count(*) AS n_tokens,
                   string_agg(tok, chr(10) ORDER BY pos) AS content FROM toks GROUP BY ALL""", "toks"),
        "topics": build("SELECT DISTINCT topic FROM corpus", "corpus"),
        "topic_documents": build(f"""
            SELECT topic, doc_id, 'documents/' || doc_id AS orgpath, n AS n_tokens FROM corpus
            WHERE topic = {_string(s.one_topic)}""", "corpus"),
        "stored_corpus": build("""
            SELECT topic, doc_id, 'documents/' || doc_id AS orgpath, count(*) AS n_tokens,
                   string_agg(tok, chr(10) ORDER BY pos) AS content FROM toks GROUP BY ALL""", "toks"),
        "content_tokens": build("SELECT topic, doc_id, pos, tok AS token FROM toks", "toks"),
        "labelled_corpus": build(f"{file_hashes} FROM kept GROUP BY topic, doc_id) GROUP BY ALL", "kept"),
        "document_folders": build(f"{file_hashes} FROM toks GROUP BY topic, doc_id) GROUP BY ALL", "toks"),
        "document_files": build(f"""
            {file_hashes} FROM toks WHERE topic = {_string(s.one_topic)} GROUP BY topic, doc_id) GROUP BY ALL""", "toks"),
        "mined_folder_files": build(
            patterns_sql.format(p="") + f" WHERE topic = {_string(s.one_topic)}", "pat"),
        "mined_folders_files": build(patterns_sql.format(p=""), "pat"),
        "discovered_files": build(f"""
            SELECT content_hash, topic, count(*) AS n FROM (
              SELECT doc_id, md5(string_agg(tok, chr(10) ORDER BY pos)) AS content_hash FROM toks
              WHERE topic = {_string(s.one_topic)} GROUP BY doc_id)
            JOIN best USING (doc_id) JOIN tids USING (topic_id) GROUP BY ALL""", "toks", "best", "tids"),
        "transaction_graphs": build("SELECT doc_id FROM src", "src"),
        "stored_characteristics": build("""
            SELECT topic, 'word' AS kind, v AS label, df AS frequency FROM uniq
            UNION ALL SELECT topic, 'graph', pattern_id, support FROM keptg""", "uniq", "keptg"),
        "stored_dictionary": build(
            "SELECT dim_id, topic_id, kind, label, n_elements FROM dims JOIN nels USING (dim_id, topic_id)", "dims", "nels"),
        "document_lines": build("SELECT tok AS token, count(*) AS n FROM toks GROUP BY tok", "toks"),
        "graph_transactions": build("SELECT doc_id, src, dst FROM e", "e"),
        "bigrams": build("SELECT topic, src, dst, count(*) AS n FROM pairs WHERE dst IS NOT NULL GROUP BY ALL", "pairs"),
        "doc_edges": build("SELECT topic, doc_id, src, dst FROM e", "e"),
        "doc_vertices": build("SELECT topic, doc_id, v FROM v", "v"),
        "self_loops": build("SELECT topic, src AS v, count(*) AS n_docs FROM e WHERE src = dst GROUP BY ALL", "e"),
        "graph_size": build("""
            SELECT topic, doc_id, n_vertices, coalesce(n_edges, 0) AS n_edges,
                   n_vertices + coalesce(n_edges, 0) AS graph_size
            FROM (SELECT topic, doc_id, count(*) AS n_vertices FROM v GROUP BY ALL)
            LEFT JOIN (SELECT topic, doc_id, count(*) AS n_edges FROM e GROUP BY ALL) USING (topic, doc_id)""", "v", "e"),
        "adjacency": build("""
            SELECT v.topic, v.doc_id, v.v, coalesce(string_agg(dst, ' ' ORDER BY dst), '') AS successors
            FROM v LEFT JOIN e ON e.topic = v.topic AND e.doc_id = v.doc_id AND e.src = v.v GROUP BY ALL""", "v", "e"),
        "graph_matrix": build("SELECT topic, doc_id, v, line FROM matrix", "matrix"),
        "graph_json": build("""
            SELECT topic, pattern_id, CAST(to_json({'nodes': nodes, 'links': coalesce(links, [])}) AS VARCHAR) AS json
            FROM (SELECT topic, pattern_id, list({'id': v} ORDER BY v) AS nodes FROM pv GROUP BY ALL)
            LEFT JOIN (SELECT topic, pattern_id, list({'source': src, 'target': dst} ORDER BY src, dst) AS links
                       FROM pe GROUP BY ALL) USING (topic, pattern_id)""", "pv", "pe"),
        "graph_count": build("SELECT topic, n_graphs FROM counts", "counts"),
        "min_support_count": build("SELECT topic, n_graphs, min_sup FROM counts", "counts"),
        "frequent_vertices": build("SELECT topic, v, df FROM ranks", "ranks"),
        "vertex_rank": build("SELECT topic, v, df, rank FROM ranks", "ranks"),
        "relabelled_edges": build("SELECT topic, doc_id, a, b FROM rel", "rel"),
        "candidate_edges": build("SELECT DISTINCT topic, a, b FROM rel", "rel"),
        "frequent_edges": build("SELECT topic, a, b, support FROM fe", "fe"),
        "seed_patterns": build("""
            SELECT topic, '0-1:' || a || '>' || b AS pattern_id, support FROM fe WHERE n_graphs > 1""", "fe"),
        "seed_extensions": build("""
            SELECT p.topic, '0-1:' || p.a || '>' || p.b AS pattern_id, x.i::BIGINT AS i, 2::BIGINT AS j, x.a, x.b,
                   count(*) AS support
            FROM fe p JOIN de d ON d.topic = p.topic AND d.a = p.a AND d.b = p.b
            JOIN (SELECT topic, doc_id, a, b, unnest([0, 1]) AS i FROM de) x
              ON x.topic = p.topic AND x.doc_id = d.doc_id AND x.a = CASE x.i WHEN 0 THEN p.a ELSE p.b END
            WHERE p.n_graphs > 1 AND p.a <> p.b AND x.b <> p.a AND x.b <> p.b
              AND ((x.i = 0 AND x.b > p.b) OR (x.i = 1 AND x.a > p.a))
            GROUP BY ALL""", "fe", "de"),
        "patterns": build(patterns_sql.format(p=""), "pat"),
        # By shape: two edges with a common end, and three of which two pairs have one, counted document by document.
        "connected_patterns": build("""
            SELECT topic, a || '>' || b AS edges, 1::BIGINT AS n_edges, support FROM fe WHERE n_graphs > 1
            UNION ALL
            SELECT topic, x.a || '>' || x.b || ' ' || y.a || '>' || y.b, 2, count(*)
            FROM de x JOIN de y USING (topic, doc_id) JOIN counts USING (topic)
            WHERE n_graphs > 1 AND (x.a, x.b) < (y.a, y.b) AND x.a <> x.b AND y.a <> y.b
              AND (x.a = y.a OR x.b = y.b OR x.a = y.b OR x.b = y.a)
            GROUP BY topic, x.a, x.b, y.a, y.b, min_sup HAVING count(*) >= min_sup
            UNION ALL
            SELECT topic, x.a || '>' || x.b || ' ' || y.a || '>' || y.b || ' ' || z.a || '>' || z.b, 3, count(*)
            FROM de x JOIN de y USING (topic, doc_id) JOIN de z USING (topic, doc_id) JOIN counts USING (topic)
            WHERE n_graphs > 1 AND (x.a, x.b) < (y.a, y.b) AND (y.a, y.b) < (z.a, z.b) AND x.a <> x.b AND y.a <> y.b AND z.a <> z.b
              AND (x.a IN (y.a, y.b) OR x.b IN (y.a, y.b))::INTEGER + (x.a IN (z.a, z.b) OR x.b IN (z.a, z.b))::INTEGER
                  + (y.a IN (z.a, z.b) OR y.b IN (z.a, z.b))::INTEGER >= 2
            GROUP BY topic, x.a, x.b, y.a, y.b, z.a, z.b, min_sup HAVING count(*) >= min_sup""", "fe", "de", "counts"),
        "pattern_docs": build("SELECT topic, pattern_id, unnest(docs) AS doc_id FROM pat", "pat"),
        "pattern_edges": build("SELECT topic, pattern_id, src, dst FROM pe", "pe"),
        "pattern_vertices": build("SELECT topic, pattern_id, v FROM pv", "pv"),
        "pattern_order": build("SELECT topic, pattern_id, graph_no FROM pat", "pat"),
        "patterns_by_folder": build(patterns_sql.format(p="folder_"), "folder_pat"),
        "unique_words": build("SELECT topic, v, df, rank FROM uniq", "uniq"),
        "mcs_size": build("""
            SELECT topic AS topic_x, pattern_id AS pattern_x, near_topic AS topic_y, near_pattern_id AS pattern_y,
                   mcs::BIGINT AS mcs_size FROM near WHERE near_topic IS NOT NULL""", "near"),
        "graph_distance": build("""
            SELECT topic AS topic_x, pattern_id AS pattern_x, near_topic AS topic_y, near_pattern_id AS pattern_y,
                   mcs::BIGINT AS mcs_size, size_x::BIGINT AS size_x, size_y::BIGINT AS size_y, distance
            FROM near WHERE near_topic IS NOT NULL""", "near"),
        "nearest_foreign_pattern": build(
            "SELECT topic, pattern_id, distance, near_topic, near_pattern_id FROM near", "near"),
        "characteristic_graphs": build("SELECT topic, pattern_id, distance FROM keptg", "keptg"),
        "characteristics": build("""
            SELECT topic, 'word' AS kind, v AS label, df AS frequency FROM uniq
            UNION ALL SELECT topic, 'graph', pattern_id, support FROM keptg""", "uniq", "keptg"),
        "store_vertices": build("""
            SELECT topic, 'word' AS kind, NULL::VARCHAR AS pattern_id, v AS name, df AS frequency FROM uniq
            UNION ALL SELECT topic, 'graph', pattern_id, v, support FROM keptg JOIN pv USING (topic, pattern_id)""",
                                "uniq", "keptg", "pv"),
        "store_edges": build("SELECT topic, pattern_id, src, dst FROM keptg JOIN pe USING (topic, pattern_id)",
                             "keptg", "pe"),
        "mining_tables": build(patterns_sql.format(p=""), "pat"),
        "mining_result_tables": build("""
            SELECT 'counts' AS part, topic, 'least ' || min_sup AS label, n_graphs AS n FROM counts
            UNION ALL SELECT 'vertices', topic, rank || ' ' || v, df FROM ranks
            UNION ALL SELECT 'patterns', topic, n_edges || ' ' || pattern_id, support FROM pat
            UNION ALL SELECT 'pattern_docs', topic, pattern_id, unnest(docs) FROM pat""", "counts", "ranks", "pat"),
        "pattern_report": build(report(
            "totals", "ranks", "pat", "n_w > 0", "true",
            f"""SELECT topic, 3, graph_no, 1, path FROM pat JOIN paths USING (topic, pattern_id)
                UNION ALL SELECT topic, 3, graph_no, 2, {fmt(REPORT_SUPPORT, 'support')} FROM pat"""),
            "totals", "paths", "ranks", "pat"),
        "characteristic_report": build(report(
            "ctotals", "uniq", "cgraphs", "true", "n_p > 0",
            "SELECT topic, 3, graph_no, position + 1, line FROM cmatrix"), "ctotals", "cmatrix", "uniq"),
        "topic_ids": build("SELECT topic_id, topic FROM tids", "tids"),
        "word_budget": build("SELECT topic, v, df, rank FROM budget", "budget"),
        "dimensions": build("SELECT dim_id, topic_id, kind, label, n_elements FROM dims JOIN nels USING (dim_id, topic_id)",
                            "dims", "nels"),
        "dictionary_tables": build("""
            SELECT 'topics' AS part, topic_id AS of, topic AS label, 1::BIGINT AS n FROM tids
            UNION ALL SELECT 'dimensions', dim_id, topic_id || ' ' || kind || ' ' || label, n_elements
                      FROM dims JOIN nels USING (dim_id, topic_id)
            UNION ALL SELECT 'elements', dim_id, x || coalesce(' > ' || y, ''), 1 FROM els
            UNION ALL SELECT 'topic_vectors', topic_id, 'from ' || first_dim, n_dims FROM tvec""", "tids", "dims", "nels", "els", "tvec"),
        "topic_vectors": build(
            "SELECT topic_id, " + vec(("(SELECT count(*) FROM dims)",
                                       "(d >= first_dim AND d < first_dim + n_dims)::INTEGER::VARCHAR"), ", ")
            + " AS vector FROM tvec", "tvec", "dims"),
        "graph_contains": build("""
            SELECT topic, pattern_id, count(*) AS n_docs FROM (
              SELECT k.topic, k.pattern_id, f.doc_id
              FROM (SELECT topic, pattern_id, v AS x, NULL AS y FROM keptg JOIN pv USING (topic, pattern_id)
                    UNION ALL SELECT topic, pattern_id, src, dst FROM keptg JOIN pe USING (topic, pattern_id)) k
              JOIN (SELECT doc_id, v AS x, NULL AS y FROM v UNION ALL SELECT doc_id, src, dst FROM e) f
                ON f.x = k.x AND f.y IS NOT DISTINCT FROM k.y
              JOIN psize z ON z.topic = k.topic AND z.pattern_id = k.pattern_id
              GROUP BY k.topic, k.pattern_id, f.doc_id, z.size HAVING count(*) = z.size)
            GROUP BY ALL""", "keptg", "pv", "pe", "v", "e", "psize"),
        "document_dims": build("SELECT doc_id, dim_id, topic_id FROM dd", "dd"),
        "document_vectors": build(
            "SELECT d.doc_id, " + vec(("(SELECT count(*) FROM dims)",
                                       "list_contains(coalesce(hits, []), d)::INTEGER::VARCHAR"), "")
            + """ AS vector FROM all_docs d LEFT JOIN (SELECT doc_id, list(dim_id) AS hits FROM dd GROUP BY doc_id) h
                  ON h.doc_id = d.doc_id""", "all_docs", "dd", "dims"),
        "topic_distance": build("""
            SELECT doc_id, topic_id, n_topic, n_doc, n_shared, distance FROM scores WHERE n_shared > 0""", "scores"),
        "nearest_topics": build("SELECT doc_id, topic_id FROM best", "best"),
        "discovered_topics": build("SELECT doc_id, topic FROM best JOIN tids USING (topic_id)", "best", "tids"),
        "prediction_lines": build("""
            SELECT doc_id, doc_id || ' :: ' || string_agg(topic, ' :: ' ORDER BY topic) AS line
            FROM new_best JOIN tids USING (topic_id) GROUP BY doc_id""", "new_best", "tids"),
    }
