"""DuckDB SQL for the Merkle manifest: runs as ordered lists, one pair of expressions for each level."""

from __future__ import annotations


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE octet_length(encode(CAST({name} AS VARCHAR))) || ':' || CAST({name} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars')))} || {_field(text)})"


#: CRC-32 of a decimal number's digits, bit by bit.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),"
    " lambda c, x: list_reduce(list_prepend(xor(c, x), CAST(range(8) AS BIGINT[])), lambda b, i: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)))"
)


def _tree(first: str, name: str, levels: int) -> tuple[str, str]:
    """Expressions for the nodes {name}0 (g, pos, h) of `first` up to {name}{levels}, and for the paths of {name}0."""
    out = [f"{name}0 AS MATERIALIZED ({first})"]
    for k in range(levels):
        # a group with one node stays as it is
        out.append(f"{name}_run{k} AS (SELECT g, pos // 16 AS pos, list(h ORDER BY pos) AS hs, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) GROUP BY 1, 2)")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}_run{k})")
    up = ", ".join(
        f"CASE WHEN r{k}.n = 1 THEN '' ELSE array_to_string(r{k}.hs[1:(z.pos // {16**k}) % 16], '') END AS {name}l{k}, CASE WHEN r{k}.n = 1 THEN '' ELSE array_to_string(r{k}.hs[(z.pos // {16**k}) % 16 + 2:], '') END AS {name}r{k}, r{k}.n = 1 AS {name}one{k}"
        for k in range(levels)
    )
    joins = " ".join(f"JOIN {name}_run{k} r{k} ON r{k}.g = z.g AND r{k}.pos = z.pos // {16 ** (k + 1)}" for k in range(levels))
    out.append(f"{name}_paths AS (SELECT z.*, {up} FROM {name}0 z {joins})")
    return ", ".join(out), name


def oracle(levels: int = 6, tops: int = 3) -> str:
    """16**levels rows of a source and 16**tops sources at most: tables for a check are smaller."""
    lower, _ = _tree("SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id, h) - 1 AS pos, h, doc_id, given FROM leaves", "a", levels)
    upper, _ = _tree(f"SELECT 0 AS g, row_number() OVER (ORDER BY g <> '', encode(g)) - 1 AS pos, h, g AS own FROM a{levels}", "b", tops)
    steps = [(f"al{k}", f"ar{k}", f"aone{k}") for k in range(levels)] + [(f"bl{k}", f"br{k}", f"bone{k}") for k in range(tops)]
    proof = " || ".join(f"{x} || {y}" for x, y, _ in steps)
    fold = "coalesce(given, h)"
    chain = []
    for i, (x, y, one) in enumerate(steps):
        chain.append(f"f{i} AS (SELECT *, CASE WHEN {one} THEN {fold if i == 0 else f'x{i - 1}'} ELSE sha256({x} || {fold if i == 0 else f'x{i - 1}'} || {y}) END AS x{i} FROM {'whole' if i == 0 else f'f{i - 1}'})")
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return (
        f"WITH leaves AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, {_leaf('text')} AS h, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(lowered)} END AS given FROM documents),"
        f" {lower}, {upper}, top AS (SELECT h AS root FROM b{tops}),"
        f" whole AS (SELECT p.*, s.h AS subroot, s.* EXCLUDE (g, pos, h, own), top.root FROM a_paths p JOIN b_paths s ON s.own = p.g CROSS JOIN top),"
        f" {', '.join(chain)}"
        f" SELECT doc_id, h AS leaf, subroot, root, sha256({proof}) AS proof_sha256, x{len(steps) - 1} AS folded_root, x{len(steps) - 1} = root AS verified FROM f{len(steps) - 1}"
    )
