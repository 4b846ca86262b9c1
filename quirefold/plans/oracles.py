"""The registered queries in plain SQL for another engine, written independently of the operators.

Each statement is a list of named steps (common table expressions) and a final SELECT over them.
"""

from __future__ import annotations

SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_ENDS = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"

STEPS: dict[str, tuple[list[str], str]] = {}
ORACLES: dict[str, str] = {}


def step(name: str, needs: list[str], sql: str) -> None:
    STEPS[name] = (needs, sql)


def oracle(name: str, needs: list[str], select: str, other: dict[str, tuple[list[str], str]] | None = None) -> None:
    """Register the SQL of a query; `other` replaces named steps for this query only."""
    known = STEPS | (other or {})
    order: list[str] = []

    def visit(step_name: str) -> None:
        for need in known[step_name][0]:
            visit(need)
        if step_name not in order:
            order.append(step_name)

    for need in needs:
        visit(need)
    steps = ", ".join(f"{n} AS ({known[n][1]})" for n in order)
    ORACLES[name] = (f"WITH {steps} " if steps else "") + select


# --- inputs ----------------------------------------------------------------------------------------

step("docs", [], "SELECT 'doc' || doc_id AS title, source AS zip_name, text FROM documents")
step(
    "files",
    [],
    """SELECT source AS folder,
              'doc' || doc_id || CASE lang WHEN 'en' THEN '.PDF' WHEN 'es' THEN '.txt' ELSE '.pdf' END AS name
       FROM documents""",
)
step(
    "page_rows",
    [],
    """SELECT 'doc' || doc_id || '.pdf' AS doc, CAST(p AS INTEGER) AS page_num,
         CASE WHEN p = 0 THEN 'COVER doc' || doc_id ELSE
           array_to_string(list_filter(
             [CASE WHEN lang = 'es' AND p > 5 THEN 'HD ' ELSE 'HEADER ' END || source,
              CASE WHEN lang = 'de' AND p > 5 THEN 'Page number ' ELSE 'Page ' END || p,
              CASE WHEN p = 1 THEN CASE WHEN lang IN ('en', 'fr') THEN 'Contents 3'
                                        WHEN lang = 'de' THEN 'Contents 9' ELSE 'Contents 1' END END]
             || ls[(p - 1) * 3 + 1 : p * 3]
             || [CASE WHEN (lang = 'en' AND p = n - 1) OR (lang = 'de' AND p = 1) THEN 'Call + 1 212 555 0100' END,
                 CASE WHEN (lang = 'en' AND p = n) OR (lang = 'fr' AND p = n - 1)
                      THEN 'This document and all of the information contained in it is provided as is.' END],
             lambda x: x IS NOT NULL), chr(10)) END AS text
       FROM (SELECT *, string_split(text, chr(10)) AS ls,
                    CAST(ceil(len(string_split(text, chr(10))) / 3.0) AS INTEGER) AS n FROM documents),
            unnest(range(0, n + 1)) AS t(p)""",
)
step(
    "questions",
    [],
    "SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS q_idx, text AS question FROM benchmark",
)
step(
    "label_store",
    [],
    """SELECT 'v' || doc_id AS id, doc_id, coalesce(d.text, '') AS chunk, 'label' || label AS title,
              coalesce(d.source, '') AS zip_name, embedding
       FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)""",
)
step(
    "answered",
    ["questions"],
    """SELECT 'label' || label AS title, q_idx, question,
              ['Answer: one and three.' || chr(10) || 'Source Chunks: 1, 3.',
               'Answer: nothing found.' || chr(10) || 'Source Chunks: None.',
               'Answer: the last.' || chr(10) || 'Source Chunks: 0.',
               'Answer: out of range.' || chr(10) || 'Source Chunks: 2, 99.',
               'Answer: twice.' || chr(10) || 'Source Chunks: 2,2. Source Chunks: 1.',
               'Answer: bad token.' || chr(10) || 'Source Chunks: 1, x.',
               'Answer: no marker.'][1 + (q_idx + label) % 7] AS response
       FROM (SELECT DISTINCT label FROM embeddings), questions""",
)

# --- scans, files, folders -------------------------------------------------------------------------

for name in ("scan_pages", "pages_roundtrip"):
    oracle(name, ["page_rows"], "SELECT doc, page_num, text FROM page_rows")
oracle("scan_text", [], "SELECT 'doc' || doc_id AS title, text FROM documents")
oracle(
    "scan_archives",
    [],
    r"""SELECT 'doc' || doc_id AS title, coalesce(source, 'none') AS zip_name,
               regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text
        FROM documents""",
)
oracle(
    "scan_text_folders",
    [],
    "SELECT 'source=' || source AS zip_name, count(*) AS n_files, true AS named FROM documents GROUP BY source",
)
oracle(
    "title_from_path",
    [],
    """SELECT page_id, split_part(parts[-1], '.', 1) AS title, coalesce(parts[-2], '') AS zip_name
       FROM (SELECT page_id, string_split(url, '/') AS parts FROM pages)""",
)
oracle("questions_second_column", ["questions"], "SELECT q_idx, question FROM questions")
oracle("filter_extension", ["files"], "SELECT folder, name FROM files WHERE name LIKE '%.pdf'")
oracle(
    "ingest_guard",
    ["files"],
    """SELECT folder, count(*) FILTER (WHERE name ILIKE '%.pdf') AS n_pdfs,
              count(*) FILTER (WHERE name ILIKE '%.pdf') >= 20 AS over_limit
       FROM files GROUP BY folder""",
)
oracle(
    "folder_up_to_date",
    ["files"],
    """SELECT folder,
         NOT EXISTS (SELECT 1 FROM (SELECT replace(name, '.pdf', '.txt') AS nm FROM files x WHERE x.folder = f.folder
                                    EXCEPT
                                    SELECT replace(name, '.pdf', '.txt') FROM files y
                                    WHERE y.folder = f.folder AND split_part(y.name, '.', 1)
                                          IN (SELECT 'doc' || doc_id FROM labels))) AS up_to_date
       FROM (SELECT DISTINCT folder FROM files) f""",
)

# --- cleaning --------------------------------------------------------------------------------------

step(
    "page_lines",
    ["page_rows"],
    f"""SELECT doc, page_num, CASE WHEN parts[-1] = '' THEN parts[1 : len(parts) - 1] ELSE parts END AS ls
        FROM (SELECT doc, page_num, string_split_regex(text, '{LINE_ENDS}') AS parts FROM page_rows)""",
)
step(
    "header",
    ["page_lines"],
    """SELECT f.doc, coalesce(min(i) FILTER (WHERE s.lens[i + 1] IS DISTINCT FROM f.lens[i + 1]), 0) AS cut,
              any_value(f.lens) AS lens
       FROM (SELECT doc, list_transform(ls, lambda x: length(x)) AS lens FROM page_lines WHERE page_num = 1) f,
            unnest(range(0, len(f.lens))) AS t(i),
            (SELECT doc, list_transform(ls, lambda x: length(x)) AS lens FROM page_lines
             WHERE page_num BETWEEN 1 AND 5) s
       WHERE s.doc = f.doc GROUP BY f.doc""",
)
step(
    "body",
    ["page_lines", "header"],
    """SELECT doc, page_num, array_to_string(ls[coalesce(
              list_min(list_filter(range(0, least(cut, len(ls))),
                lambda i: length(ls[i + 1]) - lens[i + 1] >= length(CAST(page_num + 1 AS VARCHAR))
                          OR length(ls[i + 1]) < lens[i + 1])), cut) + 1 :], chr(10)) AS text
       FROM page_lines JOIN header USING (doc) WHERE page_num >= 1""",
)
step(
    "doc_pages",
    ["body"],
    r"""SELECT doc, ps, list_position(ps, list_filter(ps, lambda x: regexp_matches(x, '\+ 1 \d{3} \d{3} \d{4}'))[-1]) AS c,
               list_max(list_filter(range(0, len(ps)), lambda i:
                 contains(ps[i + 1], 'This document and all of the information contained in it'))) AS disc
        FROM (SELECT doc, list(text ORDER BY page_num) AS ps FROM body GROUP BY doc)""",
)
step(
    "no_contacts",
    ["doc_pages"],
    "SELECT doc, disc, CASE WHEN c IS NULL THEN ps ELSE ps[1 : c - 1] || ps[c + 1 :] END AS ps FROM doc_pages",
)
step(
    "no_disclaimer",
    ["no_contacts"],
    """SELECT doc, CASE WHEN disc > 0 AND disc >= len(ps) - 3 THEN ps[1 : disc] ELSE ps END AS ps
       FROM no_contacts""",
)
step(
    "toc",
    ["no_disclaimer"],
    r"""SELECT doc, ps, CASE WHEN s > len(ps) // 10 + 1 THEN 0 WHEN s < 0 THEN greatest(len(ps) + s, 0) ELSE s END AS start
        FROM (SELECT doc, ps, coalesce(CAST(regexp_extract(
                list_filter(string_split(ps[1], chr(10)), lambda x: regexp_matches(x, '\d+\s*$'))[1],
                '(\d+)\s*$', 1) AS BIGINT) - 2, 0) AS s FROM no_disclaimer)""",
)
oracle("drop_cover", ["page_rows"], "SELECT doc, page_num, text FROM page_rows WHERE page_num >= 1")
oracle(
    "page_line_lengths",
    ["page_lines"],
    """SELECT doc, page_num, CAST(i AS INTEGER) AS line_idx, CAST(length(ls[i + 1]) AS INTEGER) AS line_len
       FROM page_lines, unnest(range(0, len(ls))) AS t(i)""",
)
oracle(
    "common_header",
    ["header"],
    """SELECT doc, CAST(cut AS INTEGER) AS common_index, coalesce(array_to_string(lens[1 : cut], ','), '') AS common_lengths
       FROM header UNION ALL
       SELECT doc, 0, '' FROM page_rows WHERE page_num = 0 AND doc NOT IN (SELECT doc FROM header)""",
)
oracle("strip_headers", ["body"], "SELECT doc, page_num, text FROM body")
for name, source in (("remove_contacts_page", "no_contacts"), ("truncate_disclaimer", "no_disclaimer")):
    oracle(
        name,
        [source],
        f"SELECT doc, CAST(i AS INTEGER) AS p1, ps[i + 1] AS text FROM {source}, unnest(range(0, len(ps))) AS t(i)",
    )
oracle("toc_start_page", ["toc"], "SELECT doc, CAST(len(ps) AS BIGINT) AS n_kept, CAST(start AS BIGINT) AS start_page FROM toc")
oracle(
    "drop_boilerplate",
    ["toc"],
    "SELECT doc, CAST(i AS INTEGER) AS p1, ps[i + 1] AS text FROM toc, unnest(range(start, len(ps))) AS t(i)",
)
oracle("merge_pages", ["toc"], "SELECT doc, coalesce(array_to_string(ps[start + 1 :], chr(10)), '') AS text FROM toc")
oracle(
    "sink_docs",
    ["toc"],
    """SELECT replace(doc, '.pdf', '.txt') AS name,
              replace(strip_accents(coalesce(array_to_string(ps[start + 1 :], chr(10)), '')), 'ß', 'ss') AS text FROM toc""",
)
oracle("ascii_fold", ["docs"], "SELECT title, replace(strip_accents(text), 'ß', 'ss') AS text FROM docs")

# --- splitting -------------------------------------------------------------------------------------

step(
    "paragraphs",
    ["docs"],
    """SELECT title, zip_name, i - 1 AS par, ps[i] AS par_text
       FROM (SELECT title, zip_name, string_split(text, chr(10)) AS ps FROM docs), unnest(range(1, len(ps) + 1)) AS t(i)""",
)
step(
    "packed",
    ["paragraphs"],
    rf"""SELECT title, zip_name, par, par_text, list_filter(string_split_regex(par_text, '{SPACES}+'), lambda w: w <> '') AS ws,
           list_reduce(
             list_transform(
               string_split(regexp_replace(par_text, '([.?!]){SPACES}+', '\1' || chr(1), 'g'), chr(1)),
               lambda s: {{'o': CAST([] AS VARCHAR[]), 'w': list_filter(string_split_regex(s, '{SPACES}+'), lambda w: w <> '')}}),
             lambda a, x: CASE WHEN len(a.w) + len(x.w) > 50
                               THEN {{'o': list_append(a.o, coalesce(array_to_string(a.w, ' '), '')), 'w': x.w}}
                               ELSE {{'o': a.o, 'w': list_concat(a.w, x.w)}} END,
             {{'o': CAST([] AS VARCHAR[]), 'w': CAST([] AS VARCHAR[])}}) AS acc
         FROM paragraphs""",
)
step(
    "units",
    ["packed"],
    """SELECT title, zip_name, sentence, row_number() OVER (PARTITION BY title ORDER BY par, part) - 1 AS idx,
              count(*) OVER (PARTITION BY title) AS n_units
       FROM (SELECT title, zip_name, par, unnest(us) AS sentence, generate_subscripts(us, 1) AS part
             FROM (SELECT title, zip_name, par, CASE WHEN len(ws) <= 50 THEN [par_text]
                     WHEN len(acc.w) > 0 THEN list_append(acc.o, array_to_string(acc.w, ' ')) ELSE acc.o END AS us
                   FROM packed))""",
)
oracle("split_paragraphs", ["paragraphs"], "SELECT title, CAST(par AS INTEGER) AS idx, par_text AS sentence FROM paragraphs")
oracle(
    "split_punctuation",
    ["docs"],
    rf"""SELECT title, CAST(i - 1 AS INTEGER) AS idx, ps[i] AS sentence
         FROM (SELECT title, string_split(regexp_replace(text, '([.?!]){SPACES}+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM docs),
              unnest(range(1, len(ps) + 1)) AS t(i)""",
)
oracle(
    "word_count",
    ["docs"],
    f"""SELECT title, CAST(len(list_filter(string_split_regex(text, '{SPACES}+'), lambda w: w <> '')) AS INTEGER) AS n_words
        FROM docs""",
)
oracle(
    "pack_large_units",
    ["units"],
    "SELECT title, CAST(n_units AS INTEGER) AS n_units, CAST(idx AS INTEGER) AS idx, sentence FROM units",
)
oracle(
    "combine_window",
    ["units"],
    """SELECT title, CAST(idx AS INTEGER) AS idx,
              coalesce(lag(sentence) OVER w || ' ' || chr(10) || chr(10), '') || sentence
              || coalesce(' ' || chr(10) || chr(10) || lead(sentence) OVER w, '') AS combined
       FROM units WINDOW w AS (PARTITION BY title ORDER BY idx)""",
)

# --- vectors and distances -------------------------------------------------------------------------


def bucket_counts(keys: str, text: str, source: str) -> str:
    """Hashed word counts of `text`: one row per key and bucket."""
    return f"""SELECT {keys}, ('0x' || md5(w)[1:8])::BIGINT % 64 AS b, CAST(count(*) AS DOUBLE) AS c
        FROM (SELECT {keys}, unnest(string_split_regex(lower(replace(strip_accents({text}), 'ß', 'ss')), '[^a-z0-9]+')) AS w
              FROM {source}) WHERE w <> '' GROUP BY ALL"""


step("unit_counts", ["units"], bucket_counts("title, idx, n_units", "sentence", "units"))
step(
    "windows",
    ["unit_counts"],
    """SELECT title, idx + d AS idx, b, sum(c) AS c FROM unit_counts, (VALUES (-1), (0), (1)) AS t(d)
       WHERE idx + d BETWEEN 0 AND n_units - 1 GROUP BY ALL""",
)
step("norms", ["windows"], "SELECT title, idx, sqrt(sum(c * c)) AS nn FROM windows GROUP BY ALL")
step(
    "dots",
    ["windows"],
    """SELECT a.title, a.idx, sum(a.c * z.c) AS p FROM windows a
       JOIN windows z ON z.title = a.title AND z.idx = a.idx + 1 AND z.b = a.b GROUP BY ALL""",
)
step(
    "distances",
    ["units", "norms", "dots"],
    """SELECT u.*, CASE WHEN u.idx < u.n_units - 1 THEN
                CASE WHEN coalesce(a.nn * z.nn, 0) = 0 THEN 1.0
                     ELSE round(1.0 - coalesce(p, 0) / (a.nn * z.nn), 6) + 0.0 END END AS distance
       FROM units u LEFT JOIN norms a ON a.title = u.title AND a.idx = u.idx
            LEFT JOIN norms z ON z.title = u.title AND z.idx = u.idx + 1
            LEFT JOIN dots d ON d.title = u.title AND d.idx = u.idx""",
)
step(
    "slopes",
    ["distances"],
    """SELECT *, round(CASE WHEN prev IS NULL THEN nxt - distance WHEN nxt IS NULL THEN distance - prev
                           ELSE (nxt - prev) / 2 END, 7) + 0.0 AS slope
       FROM (SELECT *, lag(distance) OVER w AS prev, lead(distance) OVER w AS nxt FROM distances
             WINDOW w AS (PARTITION BY title ORDER BY idx))""",
)
oracle(
    "hash_embed_units",
    ["unit_counts"],
    "SELECT title, CAST(idx AS INTEGER) AS idx, CAST(b AS INTEGER) AS dim, c AS value FROM unit_counts",
)
oracle(
    "l2_normalize_vectors",
    [],
    """SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(v[i] / nn, 6) + 0.0 AS value
       FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nn
             FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings)),
            unnest(range(1, 65)) AS t(i) WHERE v[i] <> 0""",
)
oracle("adjacent_distance", ["distances"], "SELECT title, CAST(idx AS INTEGER) AS idx, distance FROM distances")

# metric column, threshold and the documents whose units are chunks by themselves, per rule
RULES = {
    "percentile": ("distances", "distance", "quantile_cont(m, 0.85)", 1),
    "stddev": ("distances", "distance", "avg(m) + 1.0 * stddev_pop(m)", 1),
    "iqr": ("distances", "distance", "avg(m) + 0.5 * (quantile_cont(m, 0.75) - quantile_cont(m, 0.25))", 1),
    "gradient": ("slopes", "slope", "quantile_cont(m, 0.85)", 2),
    "gradient95": ("slopes", "slope", "quantile_cont(m, 0.95)", 2),
    "n_chunks": ("distances", "distance", "list(m ORDER BY m DESC)[least(4, count(m))]", 1),
}
for rule, (source, metric, threshold, bypass) in RULES.items():
    step(
        f"limit_{rule}",
        [source],
        f"""SELECT title, round({threshold}, 10) AS threshold
            FROM (SELECT title, {metric} AS m FROM {source} WHERE {metric} IS NOT NULL AND n_units > {bypass})
            GROUP BY title""",
    )
    step(
        f"breaks_{rule}",
        [f"limit_{rule}"],
        f"""SELECT s.*, threshold, CASE WHEN n_units <= {bypass} THEN idx < n_units - 1
                     ELSE coalesce({metric} > threshold, false) END AS is_break
            FROM {source} s LEFT JOIN limit_{rule} USING (title)""",
    )
    step(
        f"all_chunks_{rule}",
        [f"breaks_{rule}"],
        f"""SELECT title, chunk_idx, any_value(zip_name) AS zip_name, string_agg(sentence, ' ' ORDER BY idx) AS chunk
            FROM (SELECT *, coalesce(sum(CAST(is_break AS INTEGER)) OVER (PARTITION BY title ORDER BY idx
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_idx FROM breaks_{rule})
            GROUP BY title, chunk_idx""",
    )
    step(
        f"chunks_{rule}",
        [f"all_chunks_{rule}"],
        rf"SELECT * FROM all_chunks_{rule} WHERE regexp_matches(chunk, '[^{SPACES[1:]}')",
    )
for rule in ("percentile", "stddev", "iqr", "gradient", "n_chunks"):
    oracle(
        f"threshold_{rule}",
        [f"breaks_{rule}"],
        f"""SELECT title, any_value(threshold) AS threshold, count(*) FILTER (WHERE is_break) AS n_breaks
            FROM breaks_{rule} GROUP BY title""",
    )
oracle(
    "short_doc_bypass",
    ["breaks_gradient95"],
    """SELECT title, CAST(idx AS INTEGER) AS idx, CAST(n_units AS INTEGER) AS n_units, is_break
       FROM breaks_gradient95 WHERE n_units <= 2""",
)
for name, rule in (
    ("semantic_chunks", "percentile"),
    ("chunks_jsonl_roundtrip", "percentile"),
    ("semantic_chunks_stddev", "stddev"),
    ("semantic_chunks_iqr", "iqr"),
    ("semantic_chunks_gradient", "gradient"),
    ("semantic_chunks_n", "n_chunks"),
):
    oracle(
        name,
        [f"chunks_{rule}"],
        f"SELECT title, CAST(chunk_idx AS INTEGER) AS chunk_idx, zip_name, chunk FROM chunks_{rule}",
    )
oracle(
    "drop_blank_chunks",
    [],
    rf"""SELECT title, turn, chunk FROM
           (SELECT conv_id AS title, turn, unnest(string_split_regex(text, '[A-Za-z]+')) AS chunk FROM conversations)
         WHERE regexp_matches(chunk, '[^{SPACES[1:]}')""",
)
oracle(
    "chunk_start_index",
    ["all_chunks_percentile"],
    """SELECT title, CAST(chunk_idx AS INTEGER) AS chunk_idx,
              CAST(coalesce(sum(length(chunk)) OVER (PARTITION BY title ORDER BY chunk_idx
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_index
       FROM all_chunks_percentile""",
)
oracle(
    "chunk_metadata",
    ["all_chunks_percentile"],
    """SELECT title, CAST(chunk_idx AS INTEGER) AS chunk_idx, zip_name, CAST(quality AS VARCHAR) AS quality,
              CAST(toxic AS VARCHAR) AS toxic
       FROM all_chunks_percentile LEFT JOIN labels ON 'doc' || doc_id = title""",
)

# --- embedding, identity, store --------------------------------------------------------------------

step("chunk_counts", ["chunks_percentile"], bucket_counts("title, chunk_idx", "chunk", "chunks_percentile"))
oracle(
    "hash_embed_chunks",
    ["chunk_counts"],
    """SELECT title, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(b AS INTEGER) AS dim,
              round(c / sqrt(sum(c * c) OVER (PARTITION BY title, chunk_idx)), 6) AS value FROM chunk_counts""",
)
oracle(
    "chunk_ids",
    [],
    """SELECT title, chunk_idx, substr(sha256(title), 1, 16) || '-' ||
              (row_number() OVER (PARTITION BY title ORDER BY chunk_idx) - 1) AS id
       FROM (SELECT 'conv' || conv_id AS title, CAST(turn * 2 AS INTEGER) AS chunk_idx FROM conversations)""",
)
oracle(
    "doc_metadata",
    ["chunks_percentile"],
    "SELECT title, arg_min(zip_name, chunk_idx) AS zip_name FROM chunks_percentile GROUP BY title",
)
oracle(
    "insert_batches",
    ["paragraphs"],
    "SELECT title, par // 4 AS batch, count(*) AS n_rows FROM paragraphs GROUP BY ALL",
)
oracle(
    "chunks_per_title",
    ["chunks_percentile"],
    "SELECT title, count(*) AS n_chunks FROM chunks_percentile GROUP BY title",
)
for name in ("store_append_count", "title_chunk_counts"):
    oracle(name, ["label_store"], "SELECT title, count(*) AS n_chunks FROM label_store GROUP BY title")
oracle("filter_title", ["label_store"], "SELECT id, title, zip_name FROM label_store WHERE title = 'label3'")
oracle(
    "skip_existing_titles",
    [],
    """SELECT 'doc' || doc_id AS title, source AS zip_name FROM documents
       WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
oracle(
    "replace_changed_texts",
    ["chunks_percentile"],
    """SELECT title, substr(sha256(title), 1, 16) || '-' || (row_number() OVER (PARTITION BY title ORDER BY chunk_idx) - 1) AS id,
              chunk, zip_name FROM chunks_percentile""",
)
oracle(
    "embeddings_jsonl_roundtrip",
    ["label_store"],
    """SELECT title, zip_name, CAST(doc_id AS INTEGER) AS chunk_idx, chunk, array_to_string(list_transform(embedding,
              lambda x: printf('%.5f', CAST(x AS DOUBLE) + 0.0)), ',') AS embedding FROM label_store""",
)

# --- retrieval -------------------------------------------------------------------------------------

step("question_counts", ["questions"], bucket_counts("q_idx", "question", "questions"))
step(
    "question_dims",
    ["question_counts"],
    "SELECT q_idx, b, c / sqrt(sum(c * c) OVER (PARTITION BY q_idx)) AS x FROM question_counts",
)
step(
    "store_dims",
    ["label_store"],
    """SELECT id, title, b, y / sqrt(sum(y * y) OVER (PARTITION BY id)) AS y
       FROM (SELECT id, title, unnest(range(0, 64)) AS b, CAST(unnest(embedding) AS DOUBLE) AS y FROM label_store)""",
)
step("titles", ["label_store"], "SELECT DISTINCT title FROM label_store")
step(
    "products",
    ["question_dims", "store_dims"],
    "SELECT id, q_idx, sum(x * y) AS p FROM store_dims JOIN question_dims USING (b) GROUP BY id, q_idx",
)
RANKED = """SELECT r.* FROM
         (SELECT *, row_number() OVER (PARTITION BY title, q_idx ORDER BY distance, id) AS rank
          FROM (SELECT title, q_idx, id, chunk, round(1.0 - coalesce(p, 0), 6) + 0.0 AS distance
                FROM {candidates} LEFT JOIN products USING (id, q_idx))) r
       JOIN (SELECT title, floor(pow(CAST(count(*) AS DOUBLE), 0.4) * 2) AS k FROM label_store GROUP BY title) USING (title)
       WHERE rank <= least(k, 20)"""
step("hits", ["products", "questions", "label_store"], RANKED.format(candidates="label_store CROSS JOIN questions"))
# projections on orthonormal directions (signs of a Hadamard matrix, flipped by the first digit of an MD5), cut into
# buckets of width 1/16; buckets are visited by the product of their centre with the question
step(
    "signs",
    [],
    """SELECT j, b, (CASE WHEN bit_count(j & b) % 2 = 0 THEN 0.125 ELSE -0.125 END)
              * (CASE WHEN substr(md5(CAST(b AS VARCHAR)), 1, 1) < '8' THEN 1 ELSE -1 END) AS sign
       FROM unnest(range(0, 64)) AS x(j), unnest(range(0, 64)) AS y(b)""",
)
step(
    "buckets",
    ["signs", "store_dims"],
    """SELECT id, title, j, (floor(round(sum(y * sign), 6) * 16) + 0.5) / 16 AS centre
       FROM store_dims JOIN signs USING (b) GROUP BY id, title, j""",
)
step(
    "turned_questions",
    ["signs", "question_dims"],
    "SELECT q_idx, j, sum(x * sign) AS p FROM question_dims JOIN signs USING (b) GROUP BY q_idx, j",
)
step(
    "probes",
    ["buckets", "turned_questions"],
    """SELECT *, row_number() OVER (PARTITION BY title, q_idx ORDER BY far, id) AS probe FROM
         (SELECT title, q_idx, id, round(1 - sum(centre * p), 6) AS far FROM buckets JOIN turned_questions USING (j)
          GROUP BY title, q_idx, id)""",
)
step(
    "ks",
    ["label_store"],
    """SELECT title, count(*) AS n_chunks, least(floor(pow(CAST(count(*) AS DOUBLE), 0.4) * 2), 20) AS k
       FROM label_store GROUP BY title""",
)
step(
    "quarters",
    ["hits", "questions", "probes", "ks"],
    """SELECT greatest(floor(4 * (probe - 1) / k) + 1, 4) AS q FROM hits JOIN probes USING (title, q_idx, id) JOIN ks USING (title)
       WHERE q_idx IN (SELECT q_idx FROM questions ORDER BY md5(CAST(q_idx AS VARCHAR)), q_idx LIMIT 32)""",
)
step(
    "depth",
    ["quarters"],
    """SELECT min(q) / 4 AS depth FROM (SELECT DISTINCT q FROM quarters) d
       WHERE (SELECT avg(CASE WHEN o.q <= d.q THEN 1.0 ELSE 0.0 END) FROM quarters o) >= 0.97""",
)
step(
    "met",
    ["probes", "ks", "depth", "label_store"],
    """SELECT title, q_idx, id, chunk FROM probes JOIN ks USING (title) JOIN depth ON probe <= ceil(k * depth)
       JOIN label_store USING (title, id)""",
)
step("lsh_hits", ["products", "met", "label_store"], RANKED.format(candidates="met"))
step(
    "contexts",
    ["hits"],
    """SELECT title, q_idx, list(chunk ORDER BY rank) AS docs,
              string_agg(rank || '.' || chr(10) || chunk, chr(10) || repeat('-', 86) || chr(10) ORDER BY rank) AS context
       FROM hits GROUP BY title, q_idx""",
)
oracle(
    "hash_embed_questions",
    ["question_dims"],
    "SELECT q_idx, CAST(b AS INTEGER) AS dim, round(x, 6) AS value FROM question_dims",
)
oracle(
    "adaptive_k",
    ["docs"],
    """SELECT title, n, CAST(least(floor(pow(CAST(n AS DOUBLE), 0.4) * 2), 20) AS INTEGER) AS k
       FROM (SELECT title, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n FROM docs)""",
)
for name in ("topk_within_title", "topk_within_title_native", "topk_cells"):
    oracle(name, ["hits"], "SELECT title, q_idx, CAST(rank AS INTEGER) AS rank, id, distance FROM hits")
oracle("topk_lsh", ["lsh_hits"], "SELECT title, q_idx, CAST(rank AS INTEGER) AS rank, id, distance FROM lsh_hits")
oracle(
    "topk_lsh_recall",
    ["hits", "lsh_hits", "ks", "depth"],
    """SELECT title, n_exact, recall, round(least(ceil(k * depth) / n_chunks, 1.0), 4) AS compared FROM
         (SELECT h.title, count(*) AS n_exact, round(count(l.id) / count(*), 4) AS recall
          FROM hits h LEFT JOIN lsh_hits l USING (title, q_idx, id) GROUP BY h.title) JOIN ks USING (title), depth""",
)
oracle(
    "title_question_pairs",
    ["questions", "label_store"],
    "SELECT title, q_idx, question FROM (SELECT DISTINCT title FROM label_store), questions",
)
oracle("context_blocks", ["contexts"], "SELECT title, q_idx, context FROM contexts")

# --- answers ---------------------------------------------------------------------------------------

step(
    "prompts",
    ["contexts", "questions", "titles"],
    """SELECT title, q_idx, question,
              'Use only the numbered passages below to answer the query. Say so when they do not contain the answer '
              || 'or contradict each other. Reply in exactly this form:' || chr(10)
              || 'Answer: <X>.' || chr(10) || 'Source Chunks: <Y>.' || chr(10)
              || 'where <Y> lists the numbers of the passages you used, separated by commas, or None.'
              || chr(10) || chr(10) || 'Query: ' || question || chr(10) || 'Context:' || chr(10)
              || coalesce(context, '') || chr(10) AS prompt
       FROM titles CROSS JOIN questions LEFT JOIN contexts USING (title, q_idx)""",
)
step(
    "cited",
    ["answered"],
    r"""SELECT title, q_idx, question, response,
               CASE WHEN list_bool_and(list_transform(tokens, lambda t: regexp_matches(t, '^[+-]?[0-9]+$')))
                    THEN list_transform(tokens, lambda t: TRY_CAST(t AS INTEGER)) END AS cited
        FROM (SELECT *, list_transform(
                string_split(split_part(string_split(response, 'Source Chunks: ')[2], '.', 1), ','),
                lambda t: trim(t)) AS tokens FROM answered)""",
)
step(
    "resolved",
    ["cited", "contexts"],
    """SELECT title, q_idx, question, string_split(response, 'Source Chunks: ')[1] AS response,
              CASE WHEN cited IS NOT NULL
                    AND list_bool_and(list_transform(cited, lambda i: i <= len(docs) AND len(docs) + i >= 1))
                   THEN array_to_string(list_transform(cited,
                          lambda i: CASE WHEN i >= 1 THEN docs[i] ELSE docs[len(docs) + i] END),
                        chr(10) || repeat('-', 86) || chr(10))
                   ELSE 'Source Chunks: None' END AS source_chunks
       FROM cited LEFT JOIN contexts USING (title, q_idx)""",
)
oracle("render_prompt", ["prompts"], "SELECT title, q_idx, prompt FROM prompts")
oracle(
    "generate_hook",
    ["prompts"],
    """SELECT title, q_idx, 'Answer: ' || length(prompt) || ' characters read.' || chr(10) || 'Source Chunks: 1.' AS response
       FROM prompts""",
)
oracle("parse_citations", ["cited"], "SELECT title, q_idx, array_to_string(cited, ',') AS cited FROM cited")
oracle("resolve_citations", ["resolved"], "SELECT title, q_idx, source_chunks FROM resolved")
oracle(
    "answer_text",
    ["answered"],
    "SELECT title, q_idx, string_split(response, 'Source Chunks: ')[1] AS response FROM answered",
)
WIDE = ", ".join(
    f"""max(CASE WHEN title = 'label{i}' THEN response END) AS "label{i}-response",
        max(CASE WHEN title = 'label{i}' THEN source_chunks END) AS "label{i}-source_chunks" """
    for i in range(10)
)
for name in ("comparison_table", "sink_comparison"):
    oracle(name, ["resolved"], f"SELECT q_idx, question, {WIDE} FROM resolved GROUP BY q_idx, question")

oracle(
    "comparison_sheets",
    ["resolved"],
    """SELECT (dense_rank() OVER (ORDER BY title) - 1) // 3 AS sheet, title, q_idx, question, coalesce(response, '') AS response,
              coalesce(source_chunks, '') AS source_chunks FROM resolved""",
)

# --- the whole run: the same steps over cleaned pages and their own chunks --------------------------

CLEANED_DOCS = {
    "docs": (
        ["toc"],
        """SELECT replace(doc, '.pdf', '') AS title, '' AS zip_name,
                  replace(strip_accents(coalesce(array_to_string(ps[start + 1 :], chr(10)), '')), 'ß', 'ss') AS text
           FROM toc""",
    ),
}
for name, rule in (("page_chunks", "percentile"), ("page_chunks_gradient", "gradient"), ("page_chunks_n", "n_chunks")):
    oracle(
        name,
        [f"chunks_{rule}"],
        f"SELECT title, CAST(chunk_idx AS INTEGER) AS chunk_idx, chunk FROM chunks_{rule}",
        CLEANED_DOCS,
    )
WHOLE_RUN = (
    ["resolved"],
    "SELECT title, q_idx, response, source_chunks FROM resolved",
    CLEANED_DOCS
    | {
        "label_store": (
            ["chunks_percentile"],
            """SELECT title, zip_name, chunk, chunk_idx, substr(sha256(title), 1, 16) || '-' ||
                      (row_number() OVER (PARTITION BY title ORDER BY chunk_idx) - 1) AS id FROM chunks_percentile""",
        ),
        "store_dims": (
            ["chunk_counts", "label_store"],
            """SELECT id, b, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS y
               FROM chunk_counts JOIN label_store USING (title, chunk_idx)""",
        ),
        "titles": (["page_rows"], "SELECT DISTINCT replace(doc, '.pdf', '') AS title FROM page_rows"),
        "answered": (
            ["prompts"],
            """SELECT title, q_idx, question, 'Answer: ' || length(prompt) || ' characters read.' || chr(10) ||
                      'Source Chunks: ' || CASE WHEN contains(prompt, chr(10) || '1.' || chr(10)) THEN '1' ELSE 'None' END
                      || '.' AS response FROM prompts""",
        ),
    },
)
for name in ("full_comparison", "stored_comparison"):
    oracle(name, *WHOLE_RUN)
