"""DuckDB SQL for the rows of the queries."""

from __future__ import annotations

import re

from .bridge import VIEWS

CLOSURE = "clo AS (SELECT DISTINCT repo, cls, parent AS anc FROM par UNION SELECT c.repo, c.cls, p.parent FROM clo c JOIN par p ON p.repo = c.repo AND p.cls = c.anc)"
FIRST = "fp AS (SELECT repo, cls, arg_min(parent, ord) AS parent FROM par GROUP BY ALL), fclo AS (SELECT repo, cls, parent AS anc FROM fp UNION SELECT c.repo, c.cls, p.parent FROM fclo c JOIN fp p ON p.repo = c.repo AND p.cls = c.anc)"
AVAILABLE = "av AS (SELECT repo, cls, method FROM lm UNION SELECT repo, cls, method FROM im)"
#: Relations that several steps of one statement read are computed once.
STORED = re.sub(r"^(cls|par|met|bin|lm|im|att) AS \(", r"\1 AS MATERIALIZED (", VIEWS.strip(), flags=re.M)
BASE = f"WITH RECURSIVE {STORED}, {CLOSURE}, {FIRST}, {AVAILABLE} "


def _space(members: str, atoms: str, atom: str, key: str, text: str) -> str:
    return f"SELECT repo, cls AS subject, '{text} ''' || key || ''' in ' || cls || ': [' || who || ']' AS description FROM (SELECT l.repo, l.cls, {key} AS key, count(*) AS n, string_agg(a.{atom}, ', ' ORDER BY a.ord, a.{atom}) AS who FROM {members} l JOIN {atoms} a ON a.repo = l.repo AND a.{atom} = l.{atom} GROUP BY ALL) WHERE key IS NOT NULL AND n > 1"


EXACT = "member_name || '(' || param_types || ')'"
OVERRIDES = "WITH ov AS (SELECT l.repo, l.cls, l.method, l.return_type, l.is_abstract, b.method AS base, b.return_type AS base_type FROM (SELECT lm.repo, lm.cls, m.* EXCLUDE (repo, cls) FROM lm JOIN met m ON m.repo = lm.repo AND m.method = lm.method) l JOIN clo c ON c.repo = l.repo AND c.cls = l.cls JOIN (SELECT lm.repo, lm.cls, m.* EXCLUDE (repo, cls) FROM lm JOIN met m ON m.repo = lm.repo AND m.method = lm.method WHERE m.is_inheritable = 'Yes') b ON b.repo = c.repo AND b.cls = c.anc AND b.member_name = l.member_name AND b.param_types = l.param_types AND b.scope = l.scope)"

KEY = "CASE WHEN len(ts) = 0 THEN member_name ELSE member_name || '(' || array_to_string(ts, ',') || ')' END"
TYPES = "list_sort(list_filter(list_transform(string_split(param_types, ','), lambda x: trim(x)), lambda x: x <> ''))"

#: Methods with the checker's key.
KEYED = f"(SELECT *, {KEY} AS key FROM (SELECT *, {TYPES} AS ts FROM met))"


def _seen(chain: str) -> str:
    """What of need has a binding by the class or one of its chain."""
    met = "FROM need n JOIN bin b ON b.repo = n.repo AND b.target = n.method"
    return f"""seen AS (SELECT n.repo, n.cls, n.method {met} WHERE b.implementer = n.cls
        UNION SELECT n.repo, n.cls, n.method {met} JOIN {chain} c ON c.repo = n.repo AND c.cls = n.cls AND c.anc = b.implementer)"""


def _inherited(atoms: str, atom: str, key: list[str]) -> str:
    """The steps up to inh, the derived view of inherited members."""
    keys = ", ".join(key)
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in key)
    return f"""r AS (SELECT c.repo, c.cls, c.anc, m.{atom}, {', '.join('m.' + k for k in key)} FROM clo c
        JOIN {atoms} m ON m.repo = c.repo AND m.cls = c.anc WHERE m.is_inheritable = 'Yes'),
    f AS (SELECT r.* FROM r ANTI JOIN {atoms} o ON o.repo = r.repo AND o.cls = r.cls AND {same('o', 'r')}),
    sh AS (SELECT DISTINCT a.repo, a.cls, b.anc, {', '.join('n.' + k for k in key)} FROM clo a
        JOIN (SELECT DISTINCT repo, cls, {keys} FROM {atoms} WHERE is_inheritable = 'Yes') n ON n.repo = a.repo AND n.cls = a.anc
        JOIN clo b ON b.repo = a.repo AND b.cls = a.anc),
    inh AS (SELECT DISTINCT f.repo, f.cls, f.{atom} AS member FROM f
        ANTI JOIN sh ON sh.repo = f.repo AND sh.cls = f.cls AND sh.anc = f.anc AND {same('sh', 'f')})"""


def _difference(atoms: str, atom: str, local: str, given: str, key: list[str], relation: str) -> str:
    own = f"own AS (SELECT l.repo, l.cls, a.{atom}, a.is_inheritable, {', '.join('a.' + k for k in key)} FROM {local} l JOIN {atoms} a ON a.repo = l.repo AND a.{atom} = l.{atom})"
    return f"""SELECT * FROM (WITH {own}, {_inherited('own', atom, key)}, g AS (SELECT DISTINCT repo, cls, {atom} AS member FROM {given})
        SELECT repo, member AS subject, member || ' in {relation} of ' || cls || ' is not derived' AS description FROM g ANTI JOIN inh USING (repo, cls, member)
        UNION ALL SELECT repo, member, member || ' is missing from {relation} of ' || cls FROM inh ANTI JOIN g USING (repo, cls, member))"""


def _keys(name: str, folder: str, edit: str, gone: int) -> str:
    """The steps up to `name`, the extraction key of each repository of one state."""
    return f"""{name}_leaf AS (SELECT repo, substr(sha256(path), 1, 3) AS leaf, sha256(string_agg(h, chr(10) ORDER BY h)) AS h
        FROM (SELECT repo, path, path || ':' || sha256(coalesce(content, '')) AS h FROM (SELECT coalesce(source, 'none') || '-' || (doc_id % 40) AS repo, {folder} || 'F' || doc_id || '.java' AS path,
            CASE WHEN doc_id % 40 = 5 AND doc_id % 4 = 1 THEN text || '{edit}' ELSE text END AS content FROM documents WHERE doc_id % 40 <> {gone} AND doc_id % 9 <> 0 AND doc_id % 8 <> 3)) GROUP BY ALL),
    {name} AS (SELECT repo, sha256('spoon-v2' || chr(10) || '' || chr(10) || '17' || chr(10) || 'false' || chr(10) || sha256(string_agg(leaf || ':' || h, chr(10) ORDER BY leaf || ':' || h))) AS key FROM {name}_leaf GROUP BY repo)"""


CHECKS = {
    "chk_duplicate_names": "SELECT repo, name AS subject, 'Duplicate name ''' || name || ''' used by: ' || who AS description FROM (SELECT repo, name, count(*) AS n, string_agg(cls, ', ' ORDER BY rn) AS who FROM cls GROUP BY ALL) WHERE n > 1",
    "chk_duplicate_ids": " UNION ALL ".join(
        f"""SELECT repo, {i} AS subject, 'Duplicate {kind}ID ' || {i} || ' on ' || before || ' and ' || {a} AS description
        FROM (SELECT repo, {i}, {a}, lag({a}) OVER (PARTITION BY repo, {i} ORDER BY {o}, {a}) AS before FROM {t}) WHERE before IS NOT NULL"""
        for t, kind, i, a, o in (("cls", "Classifier", "cid", "cls", "rn"), ("met", "Method", "mid", "method", "ord"), ("att", "Attribute", "aid", "attribute", "ord"))
    ),
    "chk_exclusive_owner": " UNION ALL ".join(
        f"SELECT repo, {a} AS subject, '{kind} ' || {a} || ' declared in multiple classifiers: [' || who || ']' AS description FROM (SELECT repo, {a}, count(DISTINCT cls) AS n, string_agg(DISTINCT cls, ', ' ORDER BY cls) AS who FROM {t} GROUP BY ALL) WHERE n > 1"
        for t, kind, a in (("lm", "Method", "method"), ("la", "Attribute", "attribute"))
    ),
    "chk_cycle": "SELECT repo, cls AS subject, 'Cyclic inheritance involving ' || cls AS description FROM clo WHERE cls = anc",
    "chk_inherited_private": "SELECT im.repo, im.method AS subject, 'Private method ' || im.method || ' appears in inheritedMethods of ' || im.cls AS description FROM im JOIN met m ON m.repo = im.repo AND m.method = im.method WHERE is_inheritable = 'No' UNION ALL SELECT ia.repo, ia.attribute, 'Private attribute ' || ia.attribute || ' appears in inheritedAttributes of ' || ia.cls FROM ia JOIN att a ON a.repo = ia.repo AND a.attribute = ia.attribute WHERE is_inheritable = 'No'",
    "chk_local_inherited_disjoint": "SELECT repo, method AS subject, 'Method ' || method || ' appears in both localMethods and inheritedMethods of ' || cls AS description FROM (SELECT repo, cls, method FROM lm INTERSECT SELECT repo, cls, method FROM im) UNION ALL SELECT repo, attribute, 'Attribute ' || attribute || ' appears in both localAttributes and inheritedAttributes of ' || cls FROM (SELECT repo, cls, attribute FROM la INTERSECT SELECT repo, cls, attribute FROM ia)",
    "chk_orphan_body": """SELECT repo, body AS subject, 'Orphan MethodBody ' || body || ' has no ImplementationBinding' AS description FROM bod
        WHERE NOT EXISTS (SELECT 1 FROM bin b WHERE b.repo = bod.repo AND b.body = bod.body) AND repo IN (SELECT repo FROM bin)""",
    "chk_binding_target": "SELECT b.repo, binding AS subject, 'ImplementationBinding ' || binding || ' targets method ' || target || ' not available in ' || implementer AS description FROM bin b ANTI JOIN av ON av.repo = b.repo AND av.cls = b.implementer AND av.method = b.target",
    "chk_abstract_has_body": """SELECT repo, target AS subject, 'Abstract method ' || target || ' has a body via ' || binding || ' in declaring class ' || implementer AS description
        FROM bin WHERE EXISTS (SELECT 1 FROM lm WHERE lm.repo = bin.repo AND lm.cls = bin.implementer AND lm.method = bin.target)
        AND EXISTS (SELECT 1 FROM met m WHERE m.repo = bin.repo AND m.method = bin.target AND m.is_abstract = 'Yes')""",
    "chk_multiple_bindings": "SELECT repo, target AS subject, 'Multiple bindings for ' || implementer || '::' || target || ': [' || who || ']' AS description FROM (SELECT repo, implementer, target, count(*) AS n, string_agg(binding, ', ' ORDER BY binding) AS who FROM bin GROUP BY ALL) WHERE n > 1",
    "chk_missing_binding": """SELECT repo, method AS subject, 'Non-abstract method ' || method || ' in ' || cls || ' has no ImplementationBinding' AS description
        FROM lm WHERE EXISTS (SELECT 1 FROM met m WHERE m.repo = lm.repo AND m.method = lm.method AND m.is_abstract = 'No')
        AND NOT EXISTS (SELECT 1 FROM bin b WHERE b.repo = lm.repo AND b.implementer = lm.cls AND b.target = lm.method) AND repo IN (SELECT repo FROM bin)""",
    "chk_unresolved": f"""SELECT * FROM (WITH need AS (SELECT av.repo, av.cls, av.method FROM av JOIN cls c ON c.repo = av.repo AND c.cls = av.cls AND c.is_abstract <> 'Yes'
            WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.repo = av.repo AND m.method = av.method AND m.is_abstract = 'Yes')), {_seen('fclo')}
        SELECT repo, method AS subject, 'Non-abstract classifier ' || cls || ' has non-abstract method ' || method || ' without any ImplementationBinding' AS description
        FROM need WHERE NOT EXISTS (SELECT 1 FROM bin b WHERE b.repo = need.repo AND b.target = need.method)
        UNION ALL SELECT repo, method, 'Non-abstract classifier ' || cls || ' has non-abstract method ' || method || ' with no ImplementationBinding visible in ancestor chain'
        FROM need ANTI JOIN seen USING (repo, cls, method) WHERE EXISTS (SELECT 1 FROM bin b WHERE b.repo = need.repo AND b.target = need.method))""",
    "chk_abstract_in_concrete": "SELECT lm.repo, lm.method AS subject, 'Non-abstract classifier ' || lm.cls || ' contains abstract method ' || lm.method AS description FROM lm JOIN cls c ON c.repo = lm.repo AND c.cls = lm.cls JOIN met m ON m.repo = lm.repo AND m.method = lm.method WHERE c.is_abstract = 'No' AND m.is_abstract = 'Yes'",
    "chk_static_abstract": "SELECT repo, method AS subject, 'Method ' || method || ' is both static and abstract' AS description FROM met WHERE scope = 'Static' AND is_abstract = 'Yes'",
    "chk_local_namespace": _space("lm", KEYED, "method", "key", "Duplicate method key"),
    "spec_local_namespace": _space("lm", "met", "method", EXACT, "Duplicate method signature"),
    "chk_local_attr_namespace": _space("la", "att", "attribute", "member_name", "Duplicate attribute name"),
    "chk_inherited_method_conflict": _space("im", KEYED, "method", "key", "Inherited method conflict key"),
    "spec_inherited_method_conflict": _space("im", "met", "method", EXACT, "Inherited method conflict signature"),
    "chk_inherited_attr_conflict": _space("ia", "att", "attribute", "member_name", "Inherited attribute conflict"),
    "spec_override_return": f"""SELECT * FROM ({OVERRIDES} SELECT DISTINCT repo, method AS subject, 'Override ' || method || ' (returnType ' || return_type || ') in ' || cls
        || ' differs from overridden ' || base || ' (returnType ' || base_type || ')' AS description FROM ov WHERE return_type <> base_type)""",
    "spec_override_implemented": f"""SELECT * FROM ({OVERRIDES} SELECT repo, method AS subject, 'Override ' || method || ' in ' || cls || ' is neither abstract nor implemented' AS description
        FROM (SELECT DISTINCT repo, cls, method FROM ov WHERE is_abstract = 'No') o ANTI JOIN bin b ON b.repo = o.repo AND b.implementer = o.cls AND b.target = o.method)""",
    "chk_override_return": f"""SELECT * FROM (WITH k AS (SELECT repo, method, scope, return_type, is_abstract, {KEY} AS key FROM (SELECT *, {TYPES} AS ts FROM met)),
        o AS (SELECT l.repo, l.cls, a.method, a.return_type, a.is_abstract, b.method AS base, b.return_type AS base_type FROM lm l JOIN k a ON a.repo = l.repo AND a.method = l.method
            JOIN im i ON i.repo = l.repo AND i.cls = l.cls JOIN k b ON b.repo = i.repo AND b.method = i.method WHERE b.key = a.key AND b.scope = a.scope),
        t AS (SELECT DISTINCT p.repo, x.name AS sub, y.name AS super FROM (SELECT repo, cls, anc FROM fclo UNION SELECT repo, cls, cls FROM cls) p
            JOIN cls x ON x.repo = p.repo AND x.cls = p.cls JOIN cls y ON y.repo = p.repo AND y.cls = p.anc)
        SELECT repo, method AS subject, 'Override ' || method || ' (returnType ' || return_type || ') in ' || cls || ' is not a subtype of inherited ' || base || ' (returnType ' || base_type || ')' AS description
        FROM o ANTI JOIN t ON t.repo = o.repo AND t.sub = o.return_type AND t.super = o.base_type WHERE return_type <> base_type
        UNION ALL SELECT repo, method, 'Override ' || method || ' in ' || cls || ' is non-abstract but classifier is not a Class' FROM o ANTI JOIN cls USING (repo, cls) WHERE is_abstract <> 'Yes')""",
    "spec_unresolved": f"""SELECT * FROM (WITH need AS (SELECT av.repo, av.cls, av.method FROM av JOIN cls c ON c.repo = av.repo AND c.cls = av.cls AND c.is_abstract = 'No'), {_seen('clo')}
        SELECT repo, method AS subject, 'Non-abstract classifier ' || cls || ' has method ' || method || ' that no class of its ancestry implements' AS description
        FROM need ANTI JOIN seen USING (repo, cls, method))""",
    "spec_owner_count": " UNION ALL ".join(
        f"""SELECT x.repo, x.{a} AS subject, '{kind} ' || x.{a} || ' has ' || coalesce(n, 0) || ' owners' AS description
        FROM {t} x LEFT JOIN (SELECT repo, {a}, count(DISTINCT cls) AS n FROM {own} GROUP BY ALL) o ON o.repo = x.repo AND o.{a} = x.{a} WHERE coalesce(n, 0) <> 1"""
        for t, own, kind, a in (("met", "lm", "Method", "method"), ("att", "la", "Attribute", "attribute"))
    ),
    "spec_inherited_methods": _difference("met", "method", "lm", "im", ["member_name", "param_types"], "inheritedMethods"),
    "spec_inherited_attributes": _difference("att", "attribute", "la", "ia", ["member_name"], "inheritedAttributes"),
    "spec_body_count": """SELECT x.repo, x.body AS subject, 'MethodBody ' || x.body || ' has ' || coalesce(n, 0) || ' bindings' AS description
        FROM bod x LEFT JOIN (SELECT repo, body, count(*) AS n FROM bin GROUP BY ALL) b ON b.repo = x.repo AND b.body = x.body WHERE coalesce(n, 0) <> 1""",
    "spec_binding_count": """SELECT l.repo, l.method AS subject, 'Method ' || l.method || ' in ' || l.cls || ' has ' || coalesce(n, 0) || ' bindings' AS description
        FROM lm l JOIN met m ON m.repo = l.repo AND m.method = l.method AND m.is_abstract = 'No'
        LEFT JOIN (SELECT repo, implementer, target, count(*) AS n FROM bin GROUP BY ALL) b ON b.repo = l.repo AND b.implementer = l.cls AND b.target = l.method WHERE coalesce(n, 0) <> 1""",
    "spec_abstract_instances": """SELECT o.repo, object AS subject, 'Abstract classifier ' || o.cls || ' has direct instance ' || object AS description
        FROM obj o JOIN cls c ON c.repo = o.repo AND c.cls = o.cls AND c.is_abstract = 'Yes'""",
    "spec_object_classes": """SELECT repo, object AS subject, 'Object ' || object || ' belongs to ' || n || ' classifiers' AS description
        FROM (SELECT repo, object, count(DISTINCT cls) AS n FROM obj GROUP BY ALL) WHERE n > 1""",
    "spec_unique_oids": """SELECT repo, oid AS subject, 'ObjectID ' || oid || ' is of ' || n || ' objects' AS description
        FROM (SELECT repo, oid, count(DISTINCT object) AS n FROM obj GROUP BY ALL) WHERE n > 1""",
}
#: The invariants of the checker's rules, and of those of the specification alone.
INVARIANTS = {
    "chk_duplicate_names": "IdentifierIntegrity", "chk_duplicate_ids": "IdentifierIntegrity", "chk_exclusive_owner": "ExclusiveDeclarationOwnership",
    "chk_cycle": "AcyclicGeneralization", "chk_inherited_private": "InheritedMemberDerivation", "chk_local_inherited_disjoint": "LocalInheritedSeparation",
    "chk_orphan_body": "ImplementationBindingPolicy", "chk_binding_target": "ImplementationBindingPolicy", "chk_abstract_has_body": "ImplementationBindingPolicy",
    "chk_multiple_bindings": "ImplementationBindingPolicy", "chk_missing_binding": "ImplementationBindingPolicy", "chk_unresolved": "AbstractionPolicy",
    "chk_abstract_in_concrete": "AbstractionPolicy", "chk_static_abstract": "StaticMethodPolicy", "chk_local_namespace": "LocalMethodNamespace",
    "chk_inherited_method_conflict": "InheritedConflictPolicy", "chk_inherited_attr_conflict": "InheritedConflictPolicy", "chk_override_return": "OverridePolicy",
}
OTHER_INVARIANTS = {
    "chk_local_attr_namespace": "LocalAttributeNamespace", "spec_local_namespace": "LocalMethodNamespace", "spec_inherited_method_conflict": "InheritedConflictPolicy", "spec_unresolved": "AbstractionPolicy", "spec_override_return": "OverridePolicy",
    "spec_override_implemented": "OverridePolicy", "spec_owner_count": "ExclusiveDeclarationOwnership", "spec_inherited_methods": "InheritedMemberDerivation",
    "spec_inherited_attributes": "InheritedMemberDerivation", "spec_body_count": "ImplementationBindingPolicy", "spec_binding_count": "ImplementationBindingPolicy",
    "spec_abstract_instances": "AbstractNoDirectInstances", "spec_object_classes": "ObjectsInOneClass", "spec_unique_oids": "UniqueOids",
}


def _found(rules: dict[str, str]) -> str:
    return "v AS (" + " UNION ALL ".join(f"SELECT repo, '{i}' AS invariant, '{n}' AS check_name, subject, description FROM ({CHECKS[n]})" for n, i in rules.items()) + ")"


FOUND, WHOLE = _found(INVARIANTS), _found(INVARIANTS | OTHER_INVARIANTS)
REPOS = "(SELECT DISTINCT repo FROM cls)"
ROWS = f"""rr AS (SELECT r.repo AS repository, CASE WHEN description IS NULL THEN 'SAT' ELSE 'UNSAT' END AS result, coalesce(invariant, '') AS constraint_name,
    CAST(NULL AS INTEGER) AS line, coalesce(description, '') AS description FROM {REPOS} r LEFT JOIN v USING (repo))"""


METHODS = ", x AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rn, seq) - 1 AS n FROM met), xm AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rn, seq) - 1 AS b FROM x WHERE ln <> 2 AND is_abstract = 'No')"
CATALOG = "cat AS (SELECT p_partkey AS id, p_name AS name, p_type AS language, p_brand AS license, p_size AS stars, p_retailprice AS size FROM part)"
WANTED = "contains(lower(name), 'a') AND license IN ('Brand#11', 'Brand#12', 'Brand#23') AND stars >= 10 AND stars <= 45"
URL = r"^(?i:https)://([A-Za-z0-9.-]+)(?::443)?/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?i:\.git)?/?$"

#: The violations of each constraint of the specification: the rows of a rule, some of them, or their distinct subjects.
CONSTRAINTS = {
    "UniqueCids": "SELECT repo FROM cls GROUP BY repo, cid HAVING count(*) > 1", "UniqueMids": "SELECT repo FROM met GROUP BY repo, mid HAVING count(*) > 1", "UniqueAids": "SELECT repo FROM att GROUP BY repo, aid HAVING count(*) > 1",
    "UniqueOids": CHECKS["spec_unique_oids"], "ExclusiveMethodOwner": f"SELECT * FROM ({CHECKS['spec_owner_count']}) WHERE description LIKE 'Method %'", "ExclusiveAttributeOwner": f"SELECT * FROM ({CHECKS['spec_owner_count']}) WHERE description LIKE 'Attribute %'",
    "AcyclicGeneralization": CHECKS["chk_cycle"], "InheritedMethodView": CHECKS["spec_inherited_methods"], "InheritedAttributeView": CHECKS["spec_inherited_attributes"],
    "DisjointMethods": f"SELECT * FROM ({CHECKS['chk_local_inherited_disjoint']}) WHERE description LIKE 'Method %'", "DisjointAttributes": f"SELECT * FROM ({CHECKS['chk_local_inherited_disjoint']}) WHERE description LIKE 'Attribute %'",
    "LocalMethodNamespace": CHECKS["spec_local_namespace"], "LocalAttributeNamespace": CHECKS["chk_local_attr_namespace"], "InheritedMethodNoConflict": CHECKS["spec_inherited_method_conflict"], "InheritedAttributeNoConflict": CHECKS["chk_inherited_attr_conflict"],
    "BindingTargetValid": CHECKS["chk_binding_target"], "NoOrphanBodies": CHECKS["spec_body_count"], "SingleBinding": CHECKS["chk_multiple_bindings"],
    "AbstractNoLocal": "SELECT DISTINCT lm.repo, lm.cls, lm.method FROM lm JOIN met m ON m.repo = lm.repo AND m.method = lm.method AND m.is_abstract = 'Yes' JOIN bin b ON b.repo = lm.repo AND b.implementer = lm.cls AND b.target = lm.method",
    "NonAbstractHasBinding": CHECKS["spec_binding_count"], "UnresolvedImpliesAbstract": f"SELECT DISTINCT repo, regexp_extract(description, 'classifier (\\S+) has', 1) AS cls FROM ({CHECKS['spec_unresolved']})", "NonAbstractHasNoUnresolved": CHECKS["spec_unresolved"],
    "AbstractNoDirectInstances": CHECKS["spec_abstract_instances"], "ObjectsInOneClass": CHECKS["spec_object_classes"], "StaticNotAbstract": CHECKS["chk_static_abstract"], "OverrideReturnEquality": CHECKS["spec_override_return"], "OverrideAbstractOrImplemented": CHECKS["spec_override_implemented"],
}

ON_INSTANCE = CHECKS | {
    "spec_invariants": " UNION ALL ".join(f"SELECT repo, '{n}' AS invariant, count(*) AS n FROM ({q}) GROUP BY repo" for n, q in CONSTRAINTS.items()),
    "map_either_shape": METHODS + """ SELECT m.*, n_parents FROM (SELECT repo, return_type, param_types, is_inheritable, scope, is_abstract, count(*) AS n, min('Method' || n) AS first FROM x WHERE ln <> 2 GROUP BY ALL) m
        LEFT JOIN (SELECT repo, count(*) AS n_parents FROM fp GROUP BY 1) u ON u.repo = m.repo""",
    "committed_report": f", {FOUND}, {ROWS} SELECT repository, result, constraint_name, count(*) AS n, min(description) AS first_description FROM rr GROUP BY ALL",
    "aie_large": METHODS + """ SELECT repo, 'atom' AS kind, name, count(*) AS n FROM (SELECT repo, 'Classifier' AS name FROM cls UNION ALL SELECT repo, 'Method' FROM x WHERE ln <> 2
            UNION ALL SELECT repo, 'Attribute' FROM att UNION ALL SELECT repo, 'MethodBody' FROM xm UNION ALL SELECT DISTINCT repo, unnest(['bodies', 'bindings']) FROM cls) GROUP BY ALL
        UNION ALL SELECT repo, 'relation', name, count(*) FROM (SELECT repo, 'parents' AS name FROM fp UNION ALL SELECT repo, unnest(['implementer', 'target', 'body']) FROM xm
            UNION ALL SELECT repo, 'localMethods' FROM (SELECT DISTINCT repo, cls FROM met) UNION ALL SELECT repo, 'localAttributes' FROM (SELECT DISTINCT repo, cls FROM att)) GROUP BY ALL""",
    "report_in_lines": f", {FOUND} SELECT r.repo, CASE WHEN n > 0 THEN 'UNSAT' ELSE 'SAT' END AS result, coalesce(n, 0) AS n_violations, coalesce(d, 0) AS n_invariants FROM {REPOS} r LEFT JOIN (SELECT repo, count(*) AS n, count(DISTINCT invariant) AS d FROM v GROUP BY 1) USING (repo)",
    "incremental_report": f""", {FOUND} SELECT r.repo, state, check_name, n FROM (SELECT DISTINCT repo, CASE WHEN repo = 'Brand#13' THEN 'added' WHEN repo LIKE '%5' THEN 'changed' ELSE 'same' END AS state FROM cls
        UNION ALL SELECT DISTINCT 'Old#13', 'removed' FROM cls WHERE repo = 'Brand#13') r LEFT JOIN (SELECT repo, check_name, count(*) AS n FROM v GROUP BY ALL) c ON c.repo = r.repo""",
    "violation_cube": f""", {FOUND}, {ROWS} SELECT family, result, invariant, CAST(grouping(family, result, invariant) AS BIGINT) AS grouping, count(*) AS n
        FROM (SELECT upper(substr(repository, 1, 7)) AS family, result, nullif(nullif(constraint_name, 'AcyclicGeneralization'), '') AS invariant FROM rr) GROUP BY CUBE (family, result, invariant)""",
    "whole_verdict": f", {WHOLE} SELECT r.repo, CASE WHEN n > 0 THEN 'UNSAT' ELSE 'SAT' END AS result, coalesce(n, 0) AS n_violations FROM (SELECT DISTINCT repo FROM cls) r LEFT JOIN (SELECT repo, count(*) AS n FROM v GROUP BY 1) USING (repo)",
    "whole_matrix": f", {WHOLE} SELECT repo, invariant, check_name, count(*) AS n FROM v GROUP BY ALL",
    "whole_dead": f", {WHOLE} SELECT invariant FROM (SELECT unnest({sorted({*INVARIANTS.values(), *OTHER_INVARIANTS.values()})}) AS invariant) ANTI JOIN v USING (invariant)",
    "repo_verdict": f", {FOUND} SELECT r.repo, CASE WHEN n > 0 THEN 'UNSAT' ELSE 'SAT' END AS result, coalesce(n, 0) AS n_violations FROM (SELECT DISTINCT repo FROM cls) r LEFT JOIN (SELECT repo, count(*) AS n FROM v GROUP BY 1) USING (repo)",
    "violation_matrix": f", {FOUND} SELECT repo, invariant, check_name, count(*) AS n FROM v GROUP BY ALL",
    "verdict_counts": f", {FOUND}, w AS (SELECT r.repo, CASE WHEN n > 0 THEN 'UNSAT' ELSE 'SAT' END AS result, coalesce(n, 0) AS k FROM (SELECT DISTINCT repo FROM cls) r LEFT JOIN (SELECT repo, count(*) AS n FROM v GROUP BY 1) USING (repo)) SELECT result, count(*) AS repos, CAST(sum(k) AS BIGINT) AS n_violations FROM w GROUP BY 1",
    "repo_summary": f", {FOUND} SELECT r.repo, coalesce(n, 0) AS n_invariants, d AS first_description FROM (SELECT DISTINCT repo FROM cls) r LEFT JOIN (SELECT repo, count(DISTINCT invariant) AS n, min(description) AS d FROM v GROUP BY 1) USING (repo)",
    "audit_matrix": f", {FOUND} SELECT repo, string_agg(DISTINCT invariant, ',' ORDER BY invariant) AS fired FROM v GROUP BY 1",
    "audit_dead": f", {FOUND} SELECT invariant FROM (SELECT unnest({sorted({*INVARIANTS.values()})}) AS invariant) ANTI JOIN v USING (invariant)",
    "report_read": f", {FOUND} SELECT repo, CASE WHEN substr(repo, length(repo), 1) = '5' THEN 'ERROR' ELSE 'UNSAT' END AS result, count(*) AS n_violations FROM v GROUP BY repo",
    "result_rows": f", {FOUND} SELECT r.repo, CASE WHEN subject IS NULL THEN 'SAT' ELSE 'UNSAT' END AS result, coalesce(subject, '[unnamed constraint]') AS subject, count(*) AS n FROM {REPOS} r LEFT JOIN v USING (repo) GROUP BY ALL",
    "ancestor_closure": "SELECT repo, cls, anc FROM clo",
    "first_parent": "SELECT repo, cls, parent FROM fp",
    "ancestor_chain": "SELECT repo, cls, anc FROM fclo",
    "subtype_pairs": "SELECT DISTINCT p.repo, a.name AS sub, b.name AS super FROM (SELECT repo, cls, anc FROM fclo UNION SELECT repo, cls, cls FROM cls) p JOIN cls a ON a.repo = p.repo AND a.cls = p.cls JOIN cls b ON b.repo = p.repo AND b.cls = p.anc",
    "inherited_methods": ", " + _inherited("met", "method", ["member_name", "param_types"]) + " SELECT repo, cls, count(*) AS n, min(member) AS first_member, max(member) AS last_member FROM inh GROUP BY ALL",
    "inherited_attributes": ", " + _inherited("att", "attribute", ["member_name"]) + " SELECT repo, cls, member FROM inh",
    "available_members": "SELECT repo, cls, count(*) AS n FROM av GROUP BY ALL",
    "dup_id_pairs": "SELECT * FROM (SELECT repo, cid, cls, lag(cls) OVER (PARTITION BY repo, cid ORDER BY rn) AS previous FROM cls) WHERE previous IS NOT NULL",
    "binding_wide": "SELECT repo, binding, implementer, target, body FROM bin",
    "atom_kind": "SELECT repo, 'classifier' AS kind, count(*) AS n FROM cls GROUP BY 1 UNION ALL SELECT repo, 'method', count(*) FROM met GROUP BY 1 UNION ALL SELECT repo, 'body', count(*) FROM bod GROUP BY 1",
    "method_key": f"SELECT repo, {KEY} AS key, count(*) AS n FROM (SELECT *, list_sort(list_filter(list_transform(string_split(param_types, ','), lambda x: trim(x)), lambda x: x <> '')) AS ts FROM met) GROUP BY ALL",
    "compat_local_namespace": "SELECT repo, cls, member_name || '(' || split_part(param_types, ',', 1) || ')' AS key, count(*) AS n FROM met GROUP BY ALL HAVING count(*) > 1",
    "compat_first_duplicate": "SELECT repo, arg_min(name, rn) AS name, min(rn) AS first_ord FROM (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY rn) AS n FROM cls) WHERE n = 2 GROUP BY 1",
    "load_types": "SELECT c.repo, c.rn AS tpos, c.name || '.' || c.k AS qualifiedName, p.name || '.' || p.k AS superClass, CAST(2 AS BIGINT) AS n_fields, coalesce(e.n, 0) AS n_executables FROM cls c LEFT JOIN fp ON fp.repo = c.repo AND fp.cls = c.cls LEFT JOIN cls p ON p.repo = fp.repo AND p.cls = fp.parent LEFT JOIN (SELECT cls, count(*) AS n FROM met GROUP BY 1) e ON e.cls = c.cls",
    "map_classifier": "SELECT repo, 'Classifier' || rn AS cls, translate(name || '.' || k, '.-', '__') AS cid, name || '.' || k AS name, is_abstract FROM cls",
    "map_method": METHODS + " SELECT repo, 'Classifier' || rn AS cls, 'Method' || n AS method, member_name, return_type, param_types, is_inheritable, scope, is_abstract FROM x WHERE ln <> 2",
    "map_attribute": "SELECT repo, 'Classifier' || (ord // 10) AS cls, 'Attribute' || (row_number() OVER (PARTITION BY repo ORDER BY ord) - 1) AS attribute, member_name, CASE WHEN type = 'int' THEN 'Object' ELSE type END AS type, is_inheritable, scope FROM att",
    "map_binding": METHODS + " SELECT repo, 'ImplementationBinding' || b AS binding, 'Classifier' || rn AS implementer, 'Method' || n AS target, 'MethodBody' || b AS body FROM xm",
    "rel_parents": "SELECT c.repo, 'Classifier' || c.rn AS src, 'Classifier' || p.rn AS dst FROM fp JOIN cls c ON c.repo = fp.repo AND c.cls = fp.cls JOIN cls p ON p.repo = fp.repo AND p.cls = fp.parent",
    "aie_atoms": "SELECT repo, 'Classifier' || rn AS atom FROM cls",
    "aie_attrs": "SELECT repo, 'Classifier' || rn AS atom, 'cid' AS key, cid AS value FROM cls UNION ALL SELECT repo, 'Classifier' || rn, 'name', name FROM cls UNION ALL SELECT repo, 'Classifier' || rn, 'isAbstract', is_abstract FROM cls",
    "aie_tuples": "SELECT repo, 'parents' AS relation, cls AS src, parent AS dst FROM par",
    "combined_report": f", {FOUND}, {ROWS} SELECT lower(repository) AS repository, result, constraint_name, line, description FROM rr",
    "all_violations": f", {FOUND} SELECT repo, invariant, check_name, subject, description FROM v",
    "report_json": f""", {FOUND} SELECT r.repo, CAST(to_json(struct_pack(result := CASE WHEN vs IS NULL THEN 'SAT' ELSE 'UNSAT' END, violations := coalesce(vs, []))) AS VARCHAR) AS value
        FROM {REPOS} r LEFT JOIN (SELECT repo, list(struct_pack(invariantName := invariant, description := description) ORDER BY invariant, description) AS vs FROM v GROUP BY 1) USING (repo)""",
    "result_csv": f""", {FOUND}, {ROWS} SELECT repository || ',' || result || ',' || constraint_name || ',,'
        || CASE WHEN contains(description, ',') THEN '"' || replace(description, '"', '""') || '"' ELSE description END AS value FROM rr""",
    "results_for_repo": f", {FOUND}, {ROWS} SELECT repository, result, constraint_name, line, description FROM rr WHERE lower(repository) = 'brand#13'",
    "summary_txt": f""", {FOUND}, {ROWS} SELECT 0 AS part, '' AS repository, unnest(['Total entries: ' || count(*), 'SAT: ' || count(*) FILTER (result = 'SAT'), 'UNSAT (violations): ' || count(*) FILTER (result = 'UNSAT')]) AS value FROM rr
        UNION ALL SELECT 1, repository, '  ' || repository || ': ' || min(result) || CASE WHEN count(*) FILTER (constraint_name <> '') > 0 THEN ' (' || count(*) FILTER (constraint_name <> '') || ' violation(s))' ELSE '' END FROM rr GROUP BY repository
        UNION ALL SELECT 2, repository, '  ' || repository || ' | ' || constraint_name || ' | ' || description FROM rr WHERE result = 'UNSAT'""",
    "error_verdict": f""", {FOUND},
        bad AS (SELECT DISTINCT l.repo FROM lm l JOIN met m ON m.repo = l.repo AND m.method = l.method WHERE m.ord % 10000 = 3 AND substr(l.repo, length(l.repo), 1) = '1'
            AND EXISTS (SELECT 1 FROM im i WHERE i.repo = l.repo AND i.cls = l.cls))
        SELECT r.repo, CASE WHEN bad.repo IS NOT NULL THEN 'ERROR' WHEN n > 0 THEN 'UNSAT' ELSE 'SAT' END AS result, CAST(CASE WHEN bad.repo IS NOT NULL THEN 1 ELSE coalesce(n, 0) END AS BIGINT) AS n_violations
        FROM {REPOS} r LEFT JOIN (SELECT repo, count(*) AS n FROM v GROUP BY 1) c ON c.repo = r.repo LEFT JOIN bad ON bad.repo = r.repo""",
    "compat_first_id": """, d AS (SELECT repo, 0 AS kind, rn AS o, cls AS atom, cid AS ident, row_number() OVER (PARTITION BY repo, cid ORDER BY rn, cls) AS n FROM cls
        UNION ALL SELECT repo, 1, ord, method, mid, row_number() OVER (PARTITION BY repo, mid ORDER BY ord, method) FROM met
        UNION ALL SELECT repo, 2, ord, attribute, aid, row_number() OVER (PARTITION BY repo, aid ORDER BY ord, attribute) FROM att)
        SELECT repo, atom, ident FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY kind, o, atom, ident) AS r FROM d WHERE n > 1) WHERE r = 1""",
    "compat_first_cycle": "SELECT repo, arg_min(cls, rn) AS cls FROM (SELECT * FROM cls SEMI JOIN (SELECT repo, cls FROM clo WHERE cls = anc) USING (repo, cls)) GROUP BY 1",
    "type_count": "SELECT repo, count(*) AS n_types FROM cls GROUP BY 1",
    "sort_types": """SELECT c.repo, row_number() OVER (PARTITION BY c.repo ORDER BY c.name || '.' || c.k) - 1 AS pos, c.name || '.' || c.k AS qualifiedName, f.fields, coalesce(e.executables, '') AS executables
        FROM cls c JOIN (SELECT cls, string_agg(member_name, ',' ORDER BY member_name) AS fields FROM att GROUP BY 1) f ON f.cls = c.cls
        LEFT JOIN (SELECT cls, string_agg(member_name || '(' || param_types || ')', ';' ORDER BY member_name || '(' || param_types || ')') AS executables FROM met GROUP BY 1) e ON e.cls = c.cls""",
    "extraction_json": """SELECT repo, count(*) AS n_types, CAST(max(m) AS BIGINT) AS method_base, CAST(max(b) AS BIGINT) AS body_base FROM (
        SELECT c.repo, coalesce(sum(n) OVER w, 0) AS m, coalesce(sum(nb) OVER w, 0) AS b FROM cls c
        LEFT JOIN (SELECT cls, count(*) AS n, count(*) FILTER (ln <> 2 AND is_abstract = 'No') AS nb FROM met GROUP BY 1) e ON e.cls = c.cls
        WINDOW w AS (PARTITION BY c.repo ORDER BY c.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY 1""",
    "rel_local_methods": METHODS + " SELECT repo, 'Classifier' || rn AS src, 'Method' || n AS dst FROM x WHERE ln <> 2",
    "rel_local_attributes": "SELECT repo, 'Classifier' || (ord // 10) AS src, 'Attribute' || (row_number() OVER (PARTITION BY repo ORDER BY ord) - 1) AS dst FROM att",
    "param_signature": "SELECT repo, member_name || '(' || param_types || ')' AS signature, count(*) AS n FROM met GROUP BY ALL",
    "aie_render": METHODS + """, t AS (SELECT repo, 1 AS part, 'Classifier' || rn || ' = { cid = "' || translate(name || '.' || k, '.-', '__') || '", name = "' || name || '.' || k || '", isAbstract = ' || is_abstract || ' }' AS line FROM cls
        UNION ALL SELECT repo, 2, 'Method' || n || ' = { mid = "Method' || n || '", memberName = "' || member_name || '", returnType = "' || return_type || '", paramTypes = "' || param_types || '", isInheritable = ' || is_inheritable || ', scope = ' || scope || ', isAbstract = ' || is_abstract || ' }' FROM x WHERE ln <> 2
        UNION ALL SELECT repo, 2, 'localMethods[Classifier' || rn || '] = { ' || coalesce(string_agg('Method' || n, ', ' ORDER BY n) FILTER (ln <> 2), '') || ' }' FROM x GROUP BY repo, rn
        UNION ALL SELECT repo, 3, 'Attribute' || n || ' = { aid = "Attribute' || n || '", memberName = "' || member_name || '", type = "' || CASE WHEN type = 'int' THEN 'Object' ELSE type END || '", isInheritable = ' || is_inheritable || ', scope = ' || scope || ' }' FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ord) - 1 AS n FROM att)
        UNION ALL SELECT repo, 3, 'localAttributes[Classifier' || rn || '] = { Attribute' || 2 * rn || ', Attribute' || (2 * rn + 1) || ' }' FROM cls
        UNION ALL SELECT c.repo, 4, 'parents[Classifier' || c.rn || '] = { Classifier' || p.rn || ' }' FROM fp JOIN cls c ON c.repo = fp.repo AND c.cls = fp.cls JOIN cls p ON p.repo = fp.repo AND p.cls = fp.parent
        UNION ALL SELECT repo, 5, 'MethodBody' || b || ' = { }' || chr(10) || 'implementer[ImplementationBinding' || b || '] = { Classifier' || rn || ' }' || chr(10) || 'target[ImplementationBinding' || b || '] = { Method' || n || ' }' || chr(10) || 'body[ImplementationBinding' || b || '] = { MethodBody' || b || ' }' FROM xm)
        SELECT repo, part, count(*) AS n, min(line) AS first_line, max(line) AS last_line FROM t GROUP BY ALL""",
    "aie_round_trip": METHODS + """ SELECT repo, 'classifier' AS kind, count(*) AS n, count(DISTINCT name || '.' || k) AS names FROM cls GROUP BY 1
        UNION ALL SELECT repo, 'method', count(*), count(DISTINCT member_name) FROM x WHERE ln <> 2 GROUP BY 1
        UNION ALL SELECT repo, 'binding', count(*), count(*) FROM xm GROUP BY 1
        UNION ALL SELECT repo, 'local', count(*), count(*) FROM x WHERE ln <> 2 GROUP BY 1""",
}

LANGUAGE = "CASE WHEN doc_id % 7 < 3 THEN 'PYTHON' WHEN doc_id % 7 < 5 THEN 'JAVA' ELSE 'CPP' END"
DECLARED = "WITH f AS (SELECT p_brand AS repo, p_partkey AS k, p_size AS size, p_size % 5 AS z, 'F' || p_partkey AS path FROM part UNION ALL SELECT p_brand, p_partkey, p_size, p_size % 5, 'again/F' || p_partkey FROM part WHERE p_partkey % 5 = 0)"
PYTHON = """WITH p AS (SELECT p_brand AS repo, p_partkey AS k, p_size AS size, 'f' || p_partkey || '.py' AS path FROM part), s AS (SELECT * FROM p UNION ALL SELECT repo, k, size, 'again/' || path FROM p WHERE k % 5 = 0), f AS (SELECT * FROM s WHERE k % 17 <> 0)"""
PLAIN = {
    "catalog_search": f"WITH {CATALOG} SELECT id, name, license, stars FROM cat WHERE {WANTED}",
    "catalog_topk": f"WITH {CATALOG} SELECT id, name, stars FROM cat WHERE {WANTED} ORDER BY stars DESC, id LIMIT 50",
    "catalog_page": f"WITH {CATALOG} SELECT id, name, stars FROM cat ORDER BY stars DESC, id LIMIT 20 OFFSET 40",
    "catalog_parse": f"WITH {CATALOG} SELECT id, name, CAST(CASE WHEN stars % 2 = 0 THEN stars ELSE 0 END AS BIGINT) AS stars, CASE WHEN stars % 3 = 0 THEN license ELSE '' END AS license, false AS fork FROM cat",
    "url_normalize": f"SELECT page_id, CASE WHEN regexp_matches(url, '{URL}') THEN 'https://' || lower(regexp_extract(url, '{URL}', 1)) || '/' || regexp_extract(url, '{URL}', 2) || '/' || regexp_extract(url, '{URL}', 3) END AS repository FROM pages",
    "distinct_repos": "SELECT DISTINCT lower(p_brand) AS repo FROM part",
    "queue_dedup": "SELECT lower(event_type) AS kind, user_id, min(event_id) AS first_id FROM events GROUP BY ALL",
    "queue_merge": f"WITH {CATALOG}, k AS (SELECT lower(name || '/' || (id % 97)) AS key, stars FROM cat) SELECT DISTINCT key FROM k WHERE stars <= 25 AND key NOT IN (SELECT key FROM k WHERE stars > 25)",
    "queue_merge_stats": f"WITH {CATALOG}, k AS (SELECT lower(name || '/' || (id % 97)) AS key, stars FROM cat) SELECT count(*) FILTER (h IS NULL) AS added, count(*) FILTER (h IS NOT NULL) AS duplicate FROM (SELECT key FROM k WHERE stars <= 25) LEFT JOIN (SELECT key, 1 AS h FROM k WHERE stars > 25 GROUP BY 1) USING (key)",
    "latest_status": "SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "queue_ready": "SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type = 'purchase' AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)",
    "status_timeline": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "language_vote": f"SELECT source, total, CPP, PYTHON, JAVA, CASE WHEN CPP * 2 >= total THEN 'CPP' WHEN PYTHON * 2 >= total THEN 'PYTHON' ELSE 'JAVA' END AS language FROM (SELECT source, count(*) AS total, count(*) FILTER (l = 'CPP') AS CPP, count(*) FILTER (l = 'PYTHON') AS PYTHON, count(*) FILTER (l = 'JAVA') AS JAVA FROM (SELECT source, {LANGUAGE} AS l FROM documents) GROUP BY 1)",
    "file_filter": "SELECT page_id FROM pages WHERE NOT list_has_any(string_split(url, '/'), ['build', 'target', 'node_modules', 'en'])",
    "fingerprint": """WITH a AS (SELECT source, doc_id AS i, doc_id || ':' || sha256(coalesce(text, '')) AS h FROM documents),
        b AS (SELECT source, i // 1000 AS j, sha256(string_agg(h, chr(10) ORDER BY i)) AS h FROM a GROUP BY source, i // 1000),
        c AS (SELECT source, j // 1000 AS l, sha256(string_agg(h, chr(10) ORDER BY j)) AS h FROM b GROUP BY source, j // 1000),
        d AS (SELECT source, sha256(string_agg(h, chr(10) ORDER BY l)) AS fingerprint FROM c GROUP BY source)
        SELECT source, fingerprint, sha256(fingerprint || '|compliance=17|rules=checker') AS verify_key FROM d""",
    "invariant_lookup": """WITH sl AS (SELECT o_custkey % 50 AS spec, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS line, o_orderkey AS k FROM orders),
        inv AS (SELECT spec, line, CASE WHEN k % 26 = 0 THEN 'Inv_' || k ELSE 'Last_' || k END AS name FROM sl WHERE k % 13 = 0 AND (k % 26 = 0 OR k % 39 <> 0)),
        final AS (SELECT spec, max(line) AS m FROM sl GROUP BY 1),
        v AS (SELECT event_id, user_id % 50 AS spec, CASE WHEN event_id % 31 <> 0 THEN event_id * 7 % 400 - 2 END AS line, CASE WHEN event_id % 11 = 0 THEN 'Given' END AS given FROM events)
        SELECT event_id, v.line AS line, coalesce(given, CASE WHEN v.line BETWEEN 1 AND m AND v.line - inv.line <= 10 THEN name END) AS invariant
        FROM v ASOF LEFT JOIN inv ON v.spec = inv.spec AND v.line >= inv.line LEFT JOIN final ON final.spec = v.spec""",
    "cache_diff": f"""WITH {_keys("old", "CASE WHEN doc_id % 40 = 7 AND doc_id % 3 = 0 THEN 'old/' ELSE 'src/' END", "x", 3)}, {_keys("new", "CASE WHEN doc_id % 40 = 7 AND doc_id % 3 = 0 THEN 'new/' ELSE 'src/' END", "y", 2)}
        SELECT coalesce(o.repo, n.repo) AS repo, CASE WHEN n.repo IS NULL THEN 'removed' WHEN o.repo IS NULL THEN 'added' WHEN o.key = n.key THEN 'same' ELSE 'changed' END AS extraction,
        CASE WHEN n.repo IS NULL THEN 'removed' WHEN o.repo IS NULL THEN 'added' WHEN o.key = n.key AND o.repo NOT LIKE '%-11' AND o.repo NOT LIKE '%-12' THEN 'same' ELSE 'changed' END AS verification
        FROM old o FULL JOIN new n ON n.repo = o.repo""",
    "existing_state": """SELECT CAST(k AS VARCHAR) AS item, bool_or(e) AS extracted, bool_or(r) AS reported
        FROM (SELECT c_custkey AS k, true AS e, false AS r FROM customer UNION ALL SELECT o_custkey, false, true FROM orders WHERE o_orderstatus = 'F') GROUP BY k""",
    "extract_py": f"""{PYTHON} SELECT repo, path, 'Base' || k AS qualifiedName, 'interface' AS kind, NULL AS superClass, '' AS interfaces, true AS abstractType, CAST(1 AS BIGINT) AS methods FROM f
        UNION ALL SELECT repo, path, 'C' || k, 'class', 'Base' || k, 'Mixin', false, 2 FROM f UNION ALL SELECT repo, path, 'C' || k || '.Inner', 'class', NULL, '', false, 0 FROM f""",
    "extract_py_members": f"""{PYTHON} SELECT repo, path, 'Base' || k AS qualifiedName, x.* FROM f, (VALUES ('field', 'limit', 'int', 'public', false, ''), ('field', '_kind', 'unknown', 'protected', false, ''),
            ('executable', 'run', 'int', 'public', false, 'a:str,b:unknown')) x(member, name, type, visibility, static, params)
        UNION ALL SELECT repo, path, 'C' || k, x.member, x.name || CASE WHEN x.name = 'make' THEN CAST(size AS VARCHAR) ELSE '' END, x.type, x.visibility, x.static, x.params FROM f, (VALUES ('field', '__slots', 'unknown', 'private', false, ''),
            ('executable', '__init__', 'None', 'private', false, 'x:int'), ('executable', 'make', 'None', 'public', true, 'n:Size'), ('executable', '_run', 'None', 'protected', false, '')) x(member, name, type, visibility, static, params)""",
    "extract_java": f"""{DECLARED} SELECT repo, path || '.java' AS path, 'p' || z || '.A' || k AS qualifiedName, 'class' AS kind, 'p' || z || '.Base' || k AS superClass, 'java.lang.Runnable' AS interfaces, true AS abstractType,
            'm:int[]:package-private,n' || size || ':int:package-private,s:java.lang.String:private' AS fields, 'go():void:static:package-private;run(int,List):int:abstract:package-private;<init>(q.Helper):-:public' AS executables FROM f
        UNION ALL SELECT repo, path || '.java', 'p' || z || '.Base' || k, 'class', NULL, '', false, '', '<init>():-:package-private' FROM f
        UNION ALL SELECT repo, path || '.java', 'p' || z || '.I' || k, 'interface', NULL, '', true, 'X:int:public', 'f(p' || z || '.Base' || k || '[]):void:abstract:public' FROM f
        UNION ALL SELECT repo, path || '.java', 'p' || z || '.E' || k, 'enum', NULL, '', false, 'ONE:p' || z || '.E' || k || ':public,TWO:p' || z || '.E' || k || ':public,v:int:private', '<init>():-:private' FROM f""",
    "extract_cpp": f"""{DECLARED} SELECT repo, path || '.hpp' AS path, 'n' || z || '.m.Shape' || k AS qualifiedName, 'class' AS kind, NULL AS superClass, '' AS interfaces, true AS abstractType,
            'size' || size || ':int:public,p:int *:public' AS fields, 'draw(const char *,std::map<int, int>):void:abstract:public;operator(const Shape' || k || ' &):bool:public' AS executables FROM f WHERE path NOT LIKE 'again%'
        UNION ALL SELECT repo, path || '.hpp', 'n' || z || '.m.Box' || k, 'class', 'Shape' || k, 'Mixin', false, '', 'draw(const char *,std::map<int, int>):void:public;make():Box' || k || ':static:' || 'private' FROM f WHERE path NOT LIKE 'again%'""",
    "dedup_types": f"{PYTHON} SELECT repo, n AS qualifiedName, min(path) AS path FROM (SELECT repo, path, unnest(['Base' || k, 'C' || k, 'C' || k || '.Inner']) AS n FROM f) GROUP BY ALL",
    "catalog_filters": """WITH c AS (SELECT p_partkey AS id, p_name AS name, p_type AS type, p_partkey % 50 AS forks, 'Owner' || (p_partkey % 20) AS owner,
            strftime(DATE '2020-01-01' + CAST(p_partkey % 900 AS INTEGER), '%Y-%m-%d') AS created_at FROM part)
        SELECT id, owner, forks, created_at FROM c WHERE (contains(lower(name), 'tool') OR (id % 4 = 0 AND contains(lower('A tool for ' || type), 'tool')))
        AND lower(owner) = 'owner8' AND forks <= 45 AND created_at >= '2020-06-02' AND id % 9 <> 0 AND id % 11 <> 0""",
    "catalog_selected": f"WITH {CATALOG} SELECT id, name, stars FROM cat WHERE stars <= 25",
    "catalog_scan": f"""WITH {CATALOG} SELECT id AS pos, id, name, CAST(CASE WHEN stars % 2 = 0 THEN stars ELSE 0 END AS BIGINT) AS stars, CASE WHEN stars % 3 = 0 THEN license ELSE '' END AS license,
        id % 5 = 0 AS fork, '' AS owner FROM cat WHERE id < 70""",
    "catalog_page_count": f"WITH {CATALOG} SELECT license, count(*) AS n, CAST(greatest(1, ceil(count(*) / 20.0)) AS INTEGER) AS pages FROM cat GROUP BY 1",
    "source_roots": """WITH f AS (SELECT coalesce(source, 'none') || '-' || (doc_id % 4) AS repo, CASE doc_id % 5 WHEN 0 THEN 'mod' || (doc_id % 7) || '/src/main/java' WHEN 2 THEN 'mod' || (doc_id % 3) || '/src/test/java' END AS root FROM documents)
        SELECT DISTINCT repo, root FROM f WHERE root IS NOT NULL UNION ALL SELECT repo, '' FROM f GROUP BY repo HAVING count(root) = 0""",
    "url_list": "SELECT trim(url) AS value, count(*) AS n FROM pages WHERE page_id % 5 >= 2 GROUP BY 1",
    "progress_percent": """SELECT o_custkey, CAST(least(100, round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*))) AS INTEGER) AS percent,
        greatest(0, count(*) FILTER (o_orderstatus = 'F') - 3) AS beyond FROM orders GROUP BY 1""",
    "date_parse": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 37800 END AS instant, o_orderkey * 3600 AS epoch,
        CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
}


def oracle_sql() -> dict[str, str]:
    return {k: BASE + q for k, q in ON_INSTANCE.items()} | PLAIN
