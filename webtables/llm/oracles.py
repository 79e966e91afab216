"""SQL that states the results of queries which need more than one clause of it."""

from __future__ import annotations

FANOUT, LEAF_LEVELS, GROUP_LEVELS = 16, 6, 3


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: each byte enters with the first of its eight bit steps."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    turn = "xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, b: {turn}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(concat(strlen(({value})::VARCHAR), ':', ({value})::VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join([_field(c) for c in ("doc_id", "source", "lang", "n_chars")] + [_field(text)]) + "))"


def _tree(name: str, levels: int) -> list[str]:
    """Nodes and runs of trees over ``{name}_n0`` (g, p, d), level by level; a group of one node is left as it is."""
    out = []
    for k in range(levels):
        out.append(f"{name}_c{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}_n{k})")
        out.append(f"{name}_r{k} AS (SELECT g, p // {FANOUT} AS r, list(d ORDER BY p) AS ds FROM {name}_c{k} WHERE n > 1 GROUP BY g, p // {FANOUT})")
        out.append(f"{name}_n{k + 1} AS (SELECT g, r AS p, sha256(array_to_string(ds, '')) AS d FROM {name}_r{k} UNION ALL SELECT g, p, d FROM {name}_c{k} WHERE n = 1)")
    return out


def _climb(name: str, start: str, levels: int) -> list[str]:
    """Rows of ``start`` (id, g, p, d, proof) carried up the trees; the last table is ``{name}_f{levels}``."""
    out = [f"{name}_f0 AS (SELECT * FROM {start})"]
    for k in range(levels):
        at = f"f.p % {FANOUT}"
        out.append(f"""{name}_f{k + 1} AS (SELECT f.id, f.g, f.p // {FANOUT} AS p,
  CASE WHEN r.ds IS NULL THEN f.d ELSE sha256(concat(array_to_string(r.ds[1:{at}], ''), f.d, array_to_string(r.ds[{at} + 2:], ''))) END AS d,
  CASE WHEN r.ds IS NULL THEN f.proof ELSE concat(f.proof, array_to_string(r.ds[1:{at}], ''), array_to_string(r.ds[{at} + 2:], '')) END AS proof
  FROM {name}_f{k} f LEFT JOIN {name}_r{k} r ON r.g IS NOT DISTINCT FROM f.g AND r.r = f.p // {FANOUT})""")
    return out


def merkle_sql() -> str:
    """Manifest of ``documents``: up to 16 ** 6 rows of a source and 16 ** 3 sources."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"""leaves AS (SELECT row_number() OVER (ORDER BY source, doc_id) AS id, doc_id, source AS g, {_leaf('text')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(lowered)} END AS tampered FROM documents)""",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves)",
        "l_n0 AS (SELECT g, p, leaf AS d FROM placed)",
        *_tree("l", LEAF_LEVELS),
        f"subroots AS (SELECT g AS of_g, d AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p FROM l_n{LEAF_LEVELS})",
        "s_n0 AS (SELECT 0 AS g, p, subroot AS d FROM subroots)",
        *_tree("s", GROUP_LEVELS),
        f"top AS (SELECT d AS root FROM s_n{GROUP_LEVELS})",
        "l_start AS (SELECT id, g, p, coalesce(tampered, leaf) AS d, '' AS proof FROM placed)",
        *_climb("l", "l_start", LEAF_LEVELS),
        f"s_start AS (SELECT f.id, 0 AS g, s.p, f.d, f.proof FROM l_f{LEAF_LEVELS} f JOIN subroots s ON s.of_g IS NOT DISTINCT FROM f.g)",
        *_climb("s", "s_start", GROUP_LEVELS),
    ]
    return "WITH " + ",\n".join(steps) + f"""
SELECT l.doc_id, l.leaf, s.subroot, top.root, sha256(f.proof) AS proof_sha256, f.d AS folded_root, f.d = top.root AS verified
FROM leaves l JOIN s_f{GROUP_LEVELS} f ON f.id = l.id JOIN subroots s ON s.of_g IS NOT DISTINCT FROM l.g CROSS JOIN top"""


def _edited(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state (cost c, audit a, text o) after one more edit."""
    out = f"{state}.o" if line is None else f"concat_ws(chr(10), {state}.o, {line})"
    return f"{{'c': {state}.c + {cost}, 'a': concat({state}.a, '{letter}'), 'o': {out}}}"


def _best(*states: str) -> str:
    """The state of least cost, of equal ones that with the least audit."""
    return f"list_sort([{', '.join(states)}])[1]"


def repair_sql() -> str:
    """Repair of ``conversations``: row by row, the best edits that end in each of four states."""
    hit = crc32_sql("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    far = "{'c': 1000000000::BIGINT, 'a': '~', 'o': NULL::VARCHAR}"
    kept = lambda state, initial: f"CASE WHEN initial = '{initial}' AND NOT forced THEN {_edited(state, 'more', 'K', 'line')} ELSE {far} END"
    given = lambda state, role: f"CASE WHEN NOT forced THEN {_edited(state, '1 + more', 'R', f'concat({chr(39)}{role}:{chr(39)}, text)')} ELSE {far} END"
    put = lambda state, role: _edited(state, "5", "I", f"'{role}:'")
    gone = lambda state: _edited(state, "2", "D")
    # none, system, user, assistant were put out last; m: before insertions, p: after them
    m2 = _best(gone("p2"), *[kept(p, "u") for p in ("p0", "p1", "p3")], *[given(p, "user") for p in ("p0", "p1", "p3")])
    u = _best("m2", put("m0", "user"), put("m1", "user"), put("m3", "user"))
    return f"""WITH RECURSIVE hits AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {hit} % 20 AS hit FROM conversations),
copied AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hits WHERE hit <> 0),
bared AS (SELECT *, rtrim(text, {blanks}) AS bare, sha256(concat(strlen(role), ':', role, text)) AS key FROM copied),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, key ORDER BY turn NULLS FIRST, copy) AS again FROM bared),
faulted AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT contains('.!?', right(bare, 1)) THEN 'truncated' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM placed),
step AS (SELECT conv_id AS conv, i, left(role, 1) AS initial, coalesce(fault IN ('blank', 'duplicate'), false) AS forced,
  CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more, text, concat(role, ':', text) AS line FROM faulted),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (previous IS NOT NULL AND concat(previous, left(role, 1)) NOT IN ('su', 'ua', 'au')) AS illegal FROM faulted GROUP BY conv_id),
begun AS (SELECT {{'c': 0::BIGINT, 'a': '', 'o': NULL::VARCHAR}} AS m0),
search(conv, i, p0, p1, p2, p3) AS (
  SELECT conv_id, 0::BIGINT, m0, {far}, {put('m0', 'user')}, {_edited(f"({put('m0', 'user')})", '5', 'I', "'assistant:'")} FROM counted, begun
  UNION ALL
  SELECT conv, i, m0, m1, u, {_best('m3', put('u', 'assistant'))} FROM (
    SELECT *, {u} AS u FROM (
      SELECT s.conv, step.i, {gone('p0')} AS m0, {_best(gone('p1'), kept('p0', 's'))} AS m1, {m2} AS m2,
        {_best(gone('p3'), kept('p2', 'a'), given('p2', 'assistant'))} AS m3
      FROM search s JOIN step ON step.conv IS NOT DISTINCT FROM s.conv AND step.i = s.i + 1))),
found AS (SELECT conv, {_best('p0', 'p3')} AS best FROM search s JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv AND c.n = s.i)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(f.best.c, 0) AS cost, coalesce(f.best.a, '') AS audit, sha256(coalesce(f.best.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN found f ON f.conv IS NOT DISTINCT FROM a.conv_id"""
