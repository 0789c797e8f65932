"""DuckDB SQL with the rows that the bytecode queries must give, over tables that were made from a disassembler's listing of the same archives (tests/make_expected.py).

The SQL restates what a query computes, from the listing's rows alone; a name in braces is one of these tables.
"""

from __future__ import annotations

import os
import re

FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "expected")

#: Common table expressions that several queries begin with.
_NAMES = "cn AS (SELECT p.path, p.idx, replace(u.text, '/', '.') AS name FROM {pool} p JOIN {pool} u ON u.path = p.path AND u.idx = p.ref1 WHERE p.kind = 'Class')"
_PAIRS = "nt AS (SELECT p.path, p.idx, a.text AS name, b.text AS descriptor FROM {pool} p JOIN {pool} a ON a.path = p.path AND a.idx = p.ref1 JOIN {pool} b ON b.path = p.path AND b.idx = p.ref2 WHERE p.kind = 'NameAndType')"
_REFS = (
    _NAMES
    + ", "
    + _PAIRS
    + """, ref AS (
  SELECT p.path, p.idx, p.kind, CASE WHEN p.kind NOT IN ('InvokeDynamic', 'Dynamic') THEN cn.name END AS owner, CASE WHEN p.kind IN ('InvokeDynamic', 'Dynamic') THEN p.ref1 END AS bootstrap, nt.name, nt.descriptor
  FROM {pool} p LEFT JOIN cn ON cn.path = p.path AND cn.idx = p.ref1 LEFT JOIN nt ON nt.path = p.path AND nt.idx = p.ref2
  WHERE p.kind IN ('Fieldref', 'Methodref', 'InterfaceMethodref', 'InvokeDynamic', 'Dynamic'))"""
)
_CALLS = (
    _REFS
    + """, call AS (
  SELECT i.path, i.method, i.pc, i.op, r.owner, r.name, r.descriptor, d.type, d.parameters AS parameter_types
  FROM {insn} i JOIN ref r ON r.path = i.path AND r.idx = i.cp LEFT JOIN {descriptor} d USING (descriptor)
  WHERE i.op IN ('getstatic', 'putstatic', 'getfield', 'putfield', 'invokevirtual', 'invokespecial', 'invokestatic', 'invokeinterface', 'invokedynamic'))"""
)
_TYPES = "super AS (SELECT name AS a, super_name AS b FROM {class} WHERE super_name IS NOT NULL UNION SELECT c.name, i.name FROM {interface} i JOIN {class} c USING (path))"
_CLOSURE = _TYPES + ", above AS (SELECT a, b FROM super UNION SELECT x.a, s.b FROM above x JOIN super s ON s.a = x.b)"
_RANGES = "rng AS (SELECT path, method, start_pc, end_pc, handler_pc, array_to_string(list_sort(list_distinct(list(type))), ' | ') AS types, min(seq) AS seq FROM {handler} GROUP BY ALL)"
_JUMPS = "jump AS (SELECT path, method, pc, target FROM {insn} WHERE target IS NOT NULL UNION SELECT path, method, pc, target FROM {arm})"
_STOPS = "('ireturn', 'lreturn', 'freturn', 'dreturn', 'areturn', 'return', 'athrow', 'goto', 'tableswitch', 'lookupswitch', 'ret', 'jsr')"
_BLOCKS = (
    _JUMPS
    + f""", ins AS (SELECT *, lead(pc) OVER (PARTITION BY path, method ORDER BY pc) AS next_pc FROM {{insn}}),
lead_pc AS (
  SELECT path, method, min(pc) AS start_pc FROM ins GROUP BY ALL
  UNION SELECT path, method, target FROM jump UNION SELECT path, method, handler_pc FROM {{handler}}
  UNION SELECT path, method, next_pc FROM ins WHERE next_pc IS NOT NULL AND (op IN {_STOPS} OR (path, method, pc) IN (SELECT (path, method, pc) FROM jump))),
of AS (SELECT i.*, (SELECT max(l.start_pc) FROM lead_pc l WHERE l.path = i.path AND l.method = i.method AND l.start_pc <= i.pc) AS block FROM ins i),
blk AS (SELECT path, method, block AS start_pc, max(pc + length) AS end_pc, max(pc) AS last_pc, arg_max(op, pc) AS last_op FROM of GROUP BY ALL)"""
)
_EDGES = (
    _BLOCKS
    + f""", edge AS (
  SELECT * FROM (
    SELECT b.path, b.method, b.start_pc AS a, j.target AS b, 'branch' AS kind FROM jump j JOIN blk b ON b.path = j.path AND b.method = j.method AND b.last_pc = j.pc
    UNION SELECT path, method, start_pc, end_pc, 'fall' FROM blk WHERE last_op NOT IN {_STOPS}
    UNION SELECT b.path, b.method, b.start_pc, h.handler_pc, 'handler' FROM blk b JOIN {{handler}} h ON h.path = b.path AND h.method = b.method AND b.start_pc < h.end_pc AND b.end_pc > h.start_pc)
  WHERE (path, method, b) IN (SELECT (path, method, start_pc) FROM blk)),
step AS (SELECT DISTINCT path, method, a, b FROM edge),
live AS (SELECT path, method, min(start_pc) AS node FROM blk GROUP BY ALL UNION SELECT l.path, l.method, s.b FROM live l JOIN step s ON s.path = l.path AND s.method = l.method AND s.a = l.node)"""
)
#: d dominates n if n cannot be reached without d: reachability once for each block left out.
_DOMINATORS = (
    _EDGES
    + """, entry AS (SELECT path, method, min(start_pc) AS node FROM blk GROUP BY ALL),
without_d AS (
  SELECT l.path, l.method, l.node AS d, e.node FROM live l JOIN entry e ON e.path = l.path AND e.method = l.method AND e.node <> l.node
  UNION SELECT w.path, w.method, w.d, s.b FROM without_d w JOIN step s ON s.path = w.path AND s.method = w.method AND s.a = w.node AND s.b <> w.d),
dom AS (
  SELECT n.path, n.method, n.node, d.node AS d FROM live n JOIN live d ON d.path = n.path AND d.method = n.method
  WHERE NOT EXISTS (FROM without_d w WHERE w.path = n.path AND w.method = n.method AND w.d = d.node AND w.node = n.node))"""
)

#: Modifier words in the order in which source has them, by bit.
_FIELD = {1: "public", 4: "protected", 2: "private", 8: "static", 16: "final", 128: "transient", 64: "volatile"}
_METHOD = {1: "public", 4: "protected", 2: "private", 1024: "abstract", 8: "static", 16: "final", 32: "synchronized", 256: "native", 2048: "strictfp"}


def _words(names: dict[int, str]) -> str:
    return " || ".join(f"CASE WHEN access & {bit} <> 0 THEN '{word} ' ELSE '' END" for bit, word in names.items())


SQL = {
    "bc_s4_entries": "SELECT archive, path, 'ok' AS status, crc32, packed_size, size, true AS crc_ok FROM {entry}",
    "bc_s11_lookup": "SELECT path, 'ok' AS status, size, crc32 AS crc FROM {entry} WHERE path = 'com/google/gson/Gson.class'",
    "bc_s10_class_bytes": "SELECT archive, path, size, crc32 AS crc FROM {entry} WHERE path LIKE '%.class' AND path NOT LIKE '%-info.class'",
    "bc_s13_classpath": "SELECT name, path FROM {class}",
    "bc_p4_names": "SELECT path, name, CASE WHEN contains(name, '.') THEN regexp_replace(name, '[.][^.]*$', '') ELSE '' END AS package, regexp_replace(name, '^.*[.]', '') AS short, regexp_extract(name, '[^.$]*$') AS last FROM {class}",
    "bc_p5_flags": f"SELECT path, kind, seq, trim(CASE kind WHEN 'field' THEN {_words(_FIELD)} ELSE {_words(_METHOD)} END) AS words FROM {{member}}",
    "bc_f1_visible_methods": "SELECT path, seq, name, descriptor FROM {member} WHERE kind = 'method' AND access & 64 = 0 AND access & 4096 = 0",
    "bc_f1_visible_fields": "SELECT path, seq, name, descriptor FROM {member} WHERE kind = 'field' AND access & 4096 = 0",
    "bc_f2_enums": "SELECT path, name FROM {class} WHERE access & 16384 <> 0 AND super_name = 'java.lang.Enum'",
    "bc_f5_enum_synthetics": "SELECT m.path, m.seq, m.name, m.descriptor FROM {member} m JOIN {class} c ON c.path = m.path JOIN {descriptor} d ON d.descriptor = m.descriptor WHERE c.super_name = 'java.lang.Enum' AND c.access & 16384 <> 0 AND ((m.name = 'values' AND d.parameters = '' AND d.type = c.name || '[]') OR (m.name = 'valueOf' AND d.parameters = 'java.lang.String' AND d.type = c.name))",
    "bc_x2_short_types": "SELECT path, seq, regexp_replace(d.type, '[A-Za-z0-9_$.]*[.]', '', 'g') AS type FROM {member} m JOIN {descriptor} d USING (descriptor) WHERE kind = 'field'",
    "bc_x3_descriptors": "SELECT path, seq, true AS ok, d.type, d.parameters FROM {member} m JOIN {descriptor} d USING (descriptor) WHERE kind = 'method'",
    "bc_x9_readable_names": """
      SELECT path, method, slot, start_pc, CASE WHEN octet_length(encode(name)) = 1 THEN 'var_' || name WHEN regexp_full_match(name, '[a-z]{0,2}') THEN 'local_' || name
        WHEN NOT regexp_matches(name, '[A-Za-z]') THEN 'field_' || name ELSE name END AS name FROM {scope} WHERE NOT generic""",
    "bc_s15_classes": "SELECT path, 'ok' AS status, n_bytes, minor, major, access, this_idx, super_idx, deprecated FROM {class}",
    "bc_s16_cp": "SELECT path, idx, kind, text AS utf8, integer, real, ref1, ref2, handle FROM {pool}",
    "bc_s16_diagnostics": "SELECT path, 0 AS seq, '' AS severity, 0 AS offset, '' AS message FROM {class} WHERE n_bytes = 0",
    "bc_s17_interfaces": "SELECT path, seq, name FROM {interface}",
    "bc_s17_fields": "SELECT path, seq, access, name, descriptor, signature, deprecated, has_const FROM {member} WHERE kind = 'field'",
    "bc_s17_methods": "SELECT path, seq, access, name, descriptor, signature, deprecated, max_stack, max_locals, code_bytes, throws FROM {member} WHERE kind = 'method'",
    "bc_s18_handlers": "SELECT * FROM {handler}",
    "bc_s19_lines": "SELECT * FROM {line}",
    "bc_s19_lvt": "SELECT path, method, slot, start_pc, length, name, type AS descriptor FROM {scope} WHERE NOT generic",
    "bc_s19_lvtt": "SELECT path, method, slot, start_pc, length, name, type AS signature FROM {scope} WHERE generic",
    "bc_s20_frames": "SELECT path, method, seq, kind, delta, chop, n_locals, n_stack FROM {frame}",
    "bc_s21_annotations": "SELECT path, owner, owner_seq, visible, seq, type FROM {annotation}",
    "bc_s22_inner": "SELECT * FROM {inner}",
    "bc_s22_bootstrap": "SELECT * FROM {bootstrap}",
    "bc_s24_insns": "SELECT * FROM {insn}",
    "bc_s25_headers": "SELECT path, name, super_name, access, coalesce((SELECT string_agg(i.name, ',' ORDER BY seq) FROM {interface} i WHERE i.path = c.path), '') AS interfaces FROM {class} c",
    "bc_j1_references": f"WITH {_REFS} SELECT * FROM ref",
    "bc_j1_constants": f"WITH {_NAMES} SELECT path, idx, 'Class' AS kind, name || '.class' AS text FROM cn UNION ALL SELECT p.path, p.idx, 'String', u.text FROM {{pool}} p JOIN {{pool}} u ON u.path = p.path AND u.idx = p.ref1 WHERE p.kind = 'String' UNION ALL SELECT path, idx, kind, integer::VARCHAR || CASE kind WHEN 'Long' THEN 'L' ELSE '' END FROM {{pool}} WHERE kind IN ('Integer', 'Long')",
    "bc_j4_calls": f"WITH {_CALLS} SELECT * FROM call",
    "bc_j5_local_variables": "SELECT a.path, a.method, a.slot, a.start_pc, a.length, a.name, a.type AS descriptor, b.type AS signature FROM {scope} a LEFT JOIN {scope} b ON b.generic AND (a.path, a.method, a.slot, a.start_pc, a.length) = (b.path, b.method, b.slot, b.start_pc, b.length) WHERE NOT a.generic",
    "bc_j6_locals_at": """
      WITH u AS (SELECT path, method, pc, var AS slot, CASE WHEN op LIKE '%store' THEN pc + length ELSE pc END AS at FROM {insn} WHERE var IS NOT NULL),
      f AS (SELECT u.path, u.method, u.pc, u.slot, s.name, s.type, row_number() OVER (PARTITION BY u.path, u.method, u.pc ORDER BY s.start_pc, s.length, s.name) AS k
            FROM u LEFT JOIN {scope} s ON NOT s.generic AND s.path = u.path AND s.method = u.method AND s.slot = u.slot AND u.at >= s.start_pc AND u.at < s.start_pc + s.length)
      SELECT path, method, pc, slot, coalesce(name, 'local' || slot) AS name, d.type FROM f LEFT JOIN {descriptor} d ON d.descriptor = f.type WHERE k = 1""",
    "bc_j12_nested_ranges": f"WITH {_RANGES} SELECT o.path, o.method, o.seq AS outer_seq, i.seq AS inner_seq FROM rng o JOIN rng i ON i.path = o.path AND i.method = o.method AND o.start_pc <= i.start_pc AND i.end_pc <= o.end_pc AND i.end_pc - i.start_pc < o.end_pc - o.start_pc",
    "bc_j13_outside_joins": """
      WITH j AS (SELECT path, method, pc, pc + length AS start_pc, target FROM {insn} WHERE op LIKE 'if%')
      SELECT DISTINCT a.path, a.method, a.start_pc, a.target AS end_pc FROM j a WHERE a.target > a.pc AND EXISTS (
        FROM j b WHERE b.path = a.path AND b.method = a.method AND b.target = a.target AND NOT (b.pc >= a.start_pc AND b.pc < a.target))""",
    "bc_j14_lambdas": f"""
      WITH {_REFS}, site AS (
        SELECT i.path, i.method, i.pc, r.name AS interface_method, d.type AS functional_type, string_split(b.args, ',')[2]::INT AS handle_idx, own.owner AS factory
        FROM {{insn}} i JOIN ref r ON r.path = i.path AND r.idx = i.cp JOIN {{descriptor}} d ON d.descriptor = r.descriptor JOIN {{bootstrap}} b ON b.path = i.path AND b.seq = r.bootstrap
        JOIN {{pool}} h ON h.path = i.path AND h.idx = b.method_idx JOIN ref own ON own.path = i.path AND own.idx = h.ref1
        WHERE i.op = 'invokedynamic')
      SELECT s.path, s.method, s.pc, s.interface_method, s.functional_type, h.handle AS handle_kind, r.owner AS impl_owner, r.name AS impl_name, r.descriptor AS impl_descriptor, m.seq AS body_seq
      FROM site s JOIN {{pool}} h ON h.path = s.path AND h.idx = s.handle_idx JOIN ref r ON r.path = s.path AND r.idx = h.ref1
      LEFT JOIN ({{class}} c JOIN {{member}} m ON m.path = c.path AND m.kind = 'method') ON c.path = s.path AND c.name = r.owner AND m.name = r.name AND m.descriptor = r.descriptor
      WHERE s.factory = 'java.lang.invoke.LambdaMetafactory'""",
    "bc_j16_overrides": f"""
      WITH RECURSIVE {_CLOSURE}
      SELECT m.path, m.seq, m.name, m.descriptor, min(o.name) AS ancestor
      FROM {{member}} m JOIN {{class}} c ON c.path = m.path JOIN above a ON a.a = c.name AND a.b <> c.name JOIN {{class}} o ON o.name = a.b
      JOIN {{member}} s ON s.path = o.path AND s.kind = 'method' AND s.name = m.name AND s.descriptor = m.descriptor AND s.access & 10 = 0
      WHERE m.kind = 'method' AND m.access & 8 = 0 AND m.name NOT LIKE '<%' GROUP BY m.path, m.seq, m.name, m.descriptor""",
    "bc_j17_enum_constants": f"""
      WITH {_CALLS}, s AS (
        SELECT k.path, k.name, min(k.pc) AS pc FROM call k JOIN {{class}} c ON c.path = k.path AND c.super_name = 'java.lang.Enum' JOIN {{member}} m ON m.path = k.path AND m.kind = 'method' AND m.seq = k.method AND m.name = '<clinit>'
        WHERE k.op = 'putstatic' AND k.owner = c.name AND k.type = c.name GROUP BY ALL)
      SELECT path, (row_number() OVER (PARTITION BY path ORDER BY pc) - 1)::INT AS ordinal, name FROM s""",
    "bc_j19_receivers": """
      WITH n AS (SELECT path, method, arg_min(name, (slot, start_pc, name)) AS name FROM {scope} WHERE NOT generic AND name <> 'this' AND name NOT LIKE 'var\\_%' ESCAPE '\\' GROUP BY ALL)
      SELECT m.path, m.seq AS method, coalesce(n.name, CASE WHEN m.access & 8 = 0 THEN 'this' END) AS name FROM {member} m LEFT JOIN n ON n.path = m.path AND n.method = m.seq WHERE m.kind = 'method' AND m.code_bytes IS NOT NULL""",
    "bc_f3_object_overrides": """
      SELECT path, seq, m.name, descriptor FROM {member} m JOIN {class} c USING (path) WHERE kind = 'method' AND m.access & 8 = 0 AND c.name <> 'java.lang.Object' AND (m.name, descriptor) IN (
        ('equals', '(Ljava/lang/Object;)Z'), ('hashCode', '()I'), ('toString', '()Ljava/lang/String;'), ('clone', '()Ljava/lang/Object;'), ('finalize', '()V'))""",
    "bc_a1_switch_arms": "SELECT path, method, pc, target, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, bool_or(label IS NULL) AS is_default FROM {arm} GROUP BY ALL",
    "bc_a2_exception_ranges": f"WITH {_RANGES} SELECT * FROM rng",
    "bc_a3_unique_returns": f"WITH {_REFS} SELECT path, owner, name, min(d.type) AS type FROM ref JOIN {{descriptor}} d USING (descriptor) WHERE kind IN ('Methodref', 'InterfaceMethodref') GROUP BY path, owner, name HAVING count(DISTINCT d.type) = 1",
    "bc_a4_diagnostics": "SELECT path, '' AS severity, '' AS message, 0 AS first_offset, 0::BIGINT AS suppressed FROM {class} WHERE n_bytes = 0",
    "bc_a5_scan_summary": "SELECT archive, count(*) AS n_classes, 0::BIGINT AS n_failed, 0::BIGINT AS n_errors, sum(n_bytes)::BIGINT AS n_bytes FROM {class} GROUP BY archive",
    "bc_a6_imports": f"""
      WITH {_NAMES}, n AS (SELECT path, name FROM cn UNION SELECT path, d.type FROM {{annotation}} a JOIN {{descriptor}} d ON d.descriptor = a.type)
      SELECT DISTINCT n.path, n.name FROM n JOIN {{class}} c ON c.path = n.path
      WHERE n.name <> c.name AND n.name NOT LIKE '[%' AND n.name NOT LIKE 'java.lang.%' AND n.name LIKE '%.%' AND NOT contains(n.name, '$')
        AND regexp_replace(n.name, '[.][^.]*$', '') <> regexp_replace(c.name, '[.][^.]*$', '')""",
    "bc_a10_unique_paths": "SELECT regexp_replace(path, '[.]class$', '.java') AS path, name AS class_name FROM {class}",
    "bc_w1_frame_offsets": "SELECT path, method, seq, (sum(delta + 1) OVER (PARTITION BY path, method ORDER BY seq) - 1)::INT AS pc FROM {frame}",
    "bc_w2_frame_locals": """
      WITH RECURSIVE small(type, code) AS (VALUES ('boolean', 'Z'), ('byte', 'B'), ('char', 'C'), ('short', 'S'), ('int', 'I'), ('long', 'J'), ('float', 'F'), ('double', 'D')),
      par AS (SELECT descriptor, unnest(string_split(parameters, ',')) AS p, generate_subscripts(string_split(parameters, ','), 1) AS k FROM {descriptor} WHERE parameters <> ''),
      typed AS (SELECT descriptor, k, CASE WHEN p LIKE '%[]' THEN repeat('[', (length(p) - length(replace(p, '[]', ''))) // 2) || coalesce(s.code, 'L' || replace(p, '[]', '') || ';') WHEN p IN ('boolean', 'byte', 'char', 'short') THEN 'int' ELSE p END AS t
                FROM par LEFT JOIN small s ON s.type = replace(p, '[]', '')),
      args AS (SELECT descriptor, list(t ORDER BY k) AS ts FROM typed GROUP BY descriptor),
      begun AS (SELECT m.path, m.seq AS method, list_concat(CASE WHEN m.access & 8 <> 0 THEN [] WHEN m.name = '<init>' THEN ['uninitializedThis'] ELSE [c.name] END, coalesce(a.ts, [])) AS v
                FROM {member} m JOIN {class} c ON c.path = m.path LEFT JOIN args a ON a.descriptor = m.descriptor WHERE m.kind = 'method'),
      own AS (SELECT path, method, seq, list(type ORDER BY entry) AS v FROM {frame_local} GROUP BY ALL),
      f AS (SELECT f.*, coalesce(own.v, []) AS own FROM {frame} f LEFT JOIN own USING (path, method, seq)),
      run AS (
        SELECT path, method, -1 AS seq, v FROM begun
        UNION ALL
        SELECT r.path, r.method, f.seq, CASE f.kind WHEN 'full' THEN f.own WHEN 'append' THEN list_concat(r.v, f.own) WHEN 'chop' THEN r.v[1:len(r.v) - f.chop] ELSE r.v END
        FROM run r JOIN f ON f.path = r.path AND f.method = r.method AND f.seq = r.seq + 1)
      SELECT path, method, seq, (unnest(range(1, len(v) + 1)) - 1)::INT AS entry, unnest(v) AS type FROM run WHERE seq >= 0""",
    "bc_w3_next_offsets": "SELECT path, method, pc, (SELECT min(n.pc) FROM {insn} n WHERE n.path = i.path AND n.method = i.method AND n.pc > i.pc) AS next_pc FROM {insn} i",
    "bc_w5_lines_of": "SELECT i.path, i.method, i.pc, (SELECT arg_max(l.line, (l.pc, -l.line)) FROM {line} l WHERE l.path = i.path AND l.method = i.method AND l.pc <= i.pc) AS line FROM {insn} i",
    "bc_w8_monitor_depth": "SELECT path, method, pc, op, sum(CASE op WHEN 'monitorenter' THEN 1 ELSE -1 END) OVER (PARTITION BY path, method ORDER BY pc)::BIGINT AS depth FROM {insn} WHERE op IN ('monitorenter', 'monitorexit')",
    "bc_w9_after_return": "SELECT path, 0 AS method, 0 AS node, 0 AS parent, '' AS role, 0 AS ord, '' AS kind, '' AS text, '' AS type, 0 AS pc, 0 AS block FROM {class} WHERE n_bytes = 0",
    "bc_w10_backward_jumps": "SELECT path, method, pc, target, op FROM {insn} WHERE target <= pc",
    "bc_g1_blocks": f"WITH {_BLOCKS} SELECT * FROM blk",
    "bc_g1_edges": f"WITH RECURSIVE {_EDGES} SELECT * FROM edge",
    "bc_w5_block_of": f"WITH {_BLOCKS} SELECT path, method, pc, block FROM of",
    "bc_g2_reachable": f"WITH RECURSIVE {_EDGES} SELECT * FROM live",
    "bc_g3_dominators": f"WITH RECURSIVE {_DOMINATORS}, rank AS (SELECT path, method, node, count(*) AS n FROM dom GROUP BY ALL) SELECT n.path, n.method, n.node, (SELECT arg_max(d.d, r.n) FROM dom d JOIN rank r ON r.path = d.path AND r.method = d.method AND r.node = d.d WHERE d.path = n.path AND d.method = n.method AND d.node = n.node AND d.d <> n.node) AS idom FROM live n",
    "bc_g3_back_edges": f"WITH RECURSIVE {_DOMINATORS} SELECT s.path, s.method, s.a AS latch, s.b AS header, true AS natural FROM step s JOIN dom d ON d.path = s.path AND d.method = s.method AND d.node = s.a AND d.d = s.b",
    "bc_g4_loops": f"""
      WITH RECURSIVE {_DOMINATORS},
      way AS (SELECT DISTINCT path, method, a, b FROM edge WHERE kind <> 'handler' AND (path, method, a) IN (SELECT (path, method, node) FROM live)),
      latch AS (SELECT w.path, w.method, w.b AS header, w.a AS latch FROM way w JOIN dom d ON d.path = w.path AND d.method = w.method AND d.node = w.a AND d.d = w.b),
      body AS (SELECT path, method, header, latch AS node FROM latch UNION SELECT path, method, header, header FROM latch
               UNION SELECT x.path, x.method, x.header, w.a FROM body x JOIN way w ON w.path = x.path AND w.method = x.method AND w.b = x.node AND x.node <> x.header),
      leaving AS (SELECT DISTINCT x.path, x.method, x.header, x.node FROM body x JOIN way w ON w.path = x.path AND w.method = x.method AND w.a = x.node
                  WHERE NOT EXISTS (FROM body y WHERE y.path = x.path AND y.method = x.method AND y.header = x.header AND y.node = w.b)),
      one AS (SELECT path, method, header, string_agg(node::VARCHAR, ',' ORDER BY node) AS blocks, count(*)::INT AS n_blocks FROM body GROUP BY ALL),
      ends AS (SELECT path, method, header, string_agg(latch::VARCHAR, ',' ORDER BY latch) AS latches FROM latch GROUP BY ALL)
      SELECT o.path, o.method, o.header, e.latches, o.blocks, o.n_blocks,
        CASE WHEN n_blocks > 1 AND EXISTS (FROM leaving l WHERE l.path = o.path AND l.method = o.method AND l.header = o.header AND l.node = o.header) THEN 'while'
             WHEN EXISTS (FROM leaving l JOIN latch t USING (path, method, header) WHERE l.path = o.path AND l.method = o.method AND l.header = o.header AND l.node = t.latch) THEN 'do-while' ELSE 'endless' END AS kind
      FROM one o JOIN ends e USING (path, method, header)""",
    "bc_g5_ancestors": f"WITH RECURSIVE {_CLOSURE} SELECT a AS name, b AS ancestor FROM above",
    "bc_w7_dead_runs": f"""
      WITH RECURSIVE {_EDGES}, m AS (SELECT of.*, (path, method, block) IN (SELECT (path, method, node) FROM live) AS ok FROM of),
      g AS (SELECT *, row_number() OVER (PARTITION BY path, method ORDER BY pc) - row_number() OVER (PARTITION BY path, method, ok ORDER BY pc) AS run FROM m)
      SELECT path, method, min(pc) AS start_pc, max(pc + length) AS end_pc FROM g WHERE NOT ok GROUP BY path, method, run""",
}


def oracle_sql() -> dict[str, str]:
    """The statements with their tables in place."""
    return {name: re.sub(r"\{(\w+)\}", lambda m: f"read_parquet('{FOLDER}/{m[1]}.parquet')", sql) for name, sql in SQL.items()}
