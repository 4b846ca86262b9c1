"""DuckDB SQL for the longer queries of this subpackage, put together from steps."""

from __future__ import annotations

_POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32


def _crc_table() -> list[int]:
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (_POLYNOMIAL if c & 1 else 0)
        table.append(c)
    return table


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    step = f"xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


# --- URL filter ---------------------------------------------------------------------------------------


def with_dots(sql: str) -> str:
    """`DOTS(path)` in the text becomes the path without dot segments, `/` if it is empty."""

    def resolved(path: str) -> str:
        steps = f"list_transform(string_split({path}, '/')[2:] || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN [''] ELSE [] END, lambda x: [x])"
        step = "CASE WHEN x = ['.'] THEN k WHEN x = ['..'] THEN k[1:greatest(len(k) - 1, 0)] ELSE list_concat(k, x) END"
        return (
            f"CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') "
            f"THEN '/' || array_to_string(list_reduce({steps}, lambda k, x: {step}, CAST([] AS VARCHAR[])), '/') ELSE {path} END"
        )

    out, at = "", 0
    while (start := sql.find("DOTS(", at)) >= 0:
        end, open_ = start + 5, 1
        while open_:
            open_ += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:start] + "(" + resolved(sql[start + 5 : end - 1]) + ")"
        at = end
    return out + sql[at:]


# --- sharding -----------------------------------------------------------------------------------------


def _sharding(dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 5, shards: int = 40) -> str:
    """The curve is followed over its corners: per bit, the corner of the cube that holds the point, turned by the
    state; corners in the order of the reflected code."""
    n = len(dimensions)
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    place = [gray.index(g) for g in range(1 << n)]
    entry = [gray[2 * ((i - 1) // 2)] if i else 0 for i in range(1 << n)]
    lowest = [0] + [(i & -i).bit_length() - 1 for i in range(1, (1 << n) + 1)]
    axis = [0] + [(lowest[i] if i % 2 == 0 else lowest[i + 1]) % n for i in range(1, 1 << n)]
    mask = (1 << n) - 1

    def turned(x: str, by: str) -> str:
        return f"((({x}) >> ({by})) | (({x}) << ({n} - ({by})))) & {mask}"

    steps = [
        "facts AS (SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, "
        + f"CASE WHEN text = '' THEN 0 ELSE {crc32('text')} END AS text_crc32, {', '.join(dimensions)} FROM documents)"
    ]
    for d in dimensions:
        steps.append(
            f"c_{d} AS (SELECT {d} AS v, (sum(count(*)) OVER (ORDER BY {d} NULLS FIRST) - count(*)) * {1 << bits} "
            f"// (SELECT count(*) FROM documents) AS level FROM documents GROUP BY {d})"
        )
    joins = " ".join(f"LEFT JOIN c_{d} ON facts.{d} = c_{d}.v" for d in dimensions)
    levels = ", ".join(f"CAST(coalesce(c_{d}.level, 0) AS BIGINT) AS l_{d}" for d in dimensions)
    steps.append(
        f"s{bits} AS (SELECT facts.*, {levels}, CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS curve "
        f"FROM facts {joins})"
    )
    for bit in reversed(range(bits)):
        corner = " | ".join(f"(((l_{d} >> {bit}) & 1) << {j})" for j, d in enumerate(dimensions))
        steps.append(f"x{bit} AS (SELECT *, xor({corner}, e) AS x, (a + 1) % {n} AS turn FROM s{bit + 1})")
        steps.append(f"y{bit} AS (SELECT *, CAST({place} AS BIGINT[])[({turned('x', 'turn')}) + 1] AS w FROM x{bit})")
        inner = turned(f"CAST({entry} AS BIGINT[])[w + 1]", f"({n} - turn) % {n}")
        steps.append(
            f"s{bit} AS (SELECT * EXCLUDE (e, a, curve, x, turn, w), xor(e, {inner}) AS e, "
            f"(a + CAST({axis} AS BIGINT[])[w + 1] + 1) % {n} AS a, (curve << {n}) | w AS curve FROM y{bit})"
        )
    steps.append(
        "placed AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS pos, "
        "count(*) OVER () AS n FROM s0)"
    )
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, "
        f"CAST(pos * {shards} // n AS INTEGER) AS shard, "
        f"row_number() OVER (PARTITION BY pos * {shards} // n ORDER BY pos) - 1 AS slot, "
        "CAST(NULL AS INTEGER) AS grown_shard, curve FROM placed"
    )


SHARDING = _sharding()


# --- manifest -----------------------------------------------------------------------------------------


def _digest(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _tree(name: str, leaves: str, levels: int) -> list[str]:
    """Level by level: `name`0 holds (t, i, h); a tree of one node is done. `name`_root holds (t, h)."""
    steps = [f"{name}0 AS MATERIALIZED ({leaves})"]
    for k in range(levels):
        steps.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT t, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} "
            f"WHERE t IN (SELECT t FROM {name}{k} WHERE i = 1) GROUP BY t, i // 16)"
        )
        steps.append(
            f"{name}_run{k} AS MATERIALIZED (SELECT t, i // 16 AS p, list(h ORDER BY i) AS hs FROM {name}{k} "
            f"WHERE t IN (SELECT t FROM {name}{k} WHERE i = 1) GROUP BY t, i // 16)"
        )
    found = " UNION ALL ".join(
        f"SELECT t, h FROM {name}{k} WHERE i = 0 AND t NOT IN (SELECT t FROM {name}{k} WHERE i = 1)" for k in range(levels + 1)
    )
    return [*steps, f"{name}_root AS MATERIALIZED ({found})"]


def _climb(name: str, start: str, levels: int) -> list[str]:
    """From rows with (t, i, proof, folded): append the siblings of every level and fold them in."""
    steps, last = [], start
    for k in range(levels):
        left = "coalesce(array_to_string(r.hs[1:i % 16], ''), '')"
        right = "coalesce(array_to_string(r.hs[i % 16 + 2:], ''), '')"
        steps.append(
            f"{name}_up{k} AS (SELECT x.* EXCLUDE (i, proof, folded), x.i // 16 AS i, "
            f"CASE WHEN r.hs IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, "
            f"CASE WHEN r.hs IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded "
            f"FROM {last} x LEFT JOIN {name}_run{k} r ON x.t = r.t AND x.i // 16 = r.p)"
        )
        last = f"{name}_up{k}"
    return steps


def _manifest(levels: int = 5, top_levels: int = 4) -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"base AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS t, {_digest('text')} AS leaf, "
        f"CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_digest(lowered)} END AS changed FROM documents)",
        "ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM base)",
        *_tree("n", "SELECT t, i, leaf AS h FROM ranked", levels),
        *_tree("m", "SELECT 'all' AS t, row_number() OVER (ORDER BY t) - 1 AS i, h FROM n_root", top_levels),
        "start AS (SELECT doc_id, t, i, leaf, '' AS proof, coalesce(changed, leaf) AS folded FROM ranked)",
        *_climb("n", "start", levels),
        "sources AS (SELECT t AS tree, row_number() OVER (ORDER BY t) - 1 AS place, h AS subroot FROM n_root)",
        f"tops AS (SELECT u.doc_id, u.leaf, s.subroot, 'all' AS t, s.place AS i, u.proof, u.folded FROM n_up{levels - 1} u JOIN sources s ON u.t = s.tree)",
        *_climb("m", "tops", top_levels),
    ]
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, "
        f"folded = h AS verified FROM m_up{top_levels - 1}, (SELECT h FROM m_root)"
    )


MANIFEST = _manifest()


# --- hard negatives -----------------------------------------------------------------------------------

HARD_NEGATIVES = """
    WITH rows AS MATERIALIZED (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS MATERIALIZED (
        SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
        FROM rows a, rows r WHERE a.vec_id % 100 = 0),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same AND vec_id <> anchor_id
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    pairs AS (
        SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
            row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
        FROM positives JOIN scores USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM pairs WHERE rank <= 10
"""
