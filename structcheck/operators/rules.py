"""Integrity rules over a relational instance.

An Instance has one DataFrame for each relation, all with the repository as leading key. A rule gives its violations as
(repo, subject, description); the registry names the invariant that each belongs to and its form: ``checker`` rules are
those of the executable checker, ``spec`` rules those that only the declarative specification has, or has otherwise.
Rules are joins, semi and anti joins and grouped counts, so that all repositories are checked in one job. Rules that
need the closure of the parents compute it when called, unless the instance holds it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structcheck.functions.tables import written
from structcheck.functions.text import method_key

from . import closure as graph
from .inherit import inherited_rows


class Instance(NamedTuple):
    """classifier: repo cls ord cid name is_abstract. method: repo method ord mid member_name return_type param_types
    is_inheritable scope is_abstract. attribute: repo attribute ord aid member_name type is_inheritable scope.
    body: repo body. binding: repo binding implementer target body. parents: repo cls parent ord.
    local_methods, inherited_methods: repo cls method. local_attributes, inherited_attributes: repo cls attribute.
    objects: repo object oid cls, if there are any. Given by `Prepared`: closure: repo cls anc, the ancestors by
    `parents`; chain: the same by first parents; local, inherited: the tuples of methods with the methods' columns;
    members: see `members_of`; body_counts: see `body_counts_of`."""

    classifier: DataFrame
    method: DataFrame
    attribute: DataFrame
    body: DataFrame
    binding: DataFrame
    parents: DataFrame
    local_methods: DataFrame
    local_attributes: DataFrame
    inherited_methods: DataFrame
    inherited_attributes: DataFrame
    objects: DataFrame | None = None
    closure: DataFrame | None = None
    chain: DataFrame | None = None
    local: DataFrame | None = None
    inherited: DataFrame | None = None
    members: DataFrame | None = None
    body_counts: DataFrame | None = None


class Rule(NamedTuple):
    name: str
    invariant: str
    form: str
    check: Callable[[Instance], DataFrame]


REGISTRY: dict[str, Rule] = {}


def rule(name: str, invariant: str, form: str = "checker"):
    def add(f):
        REGISTRY[name] = Rule(name, invariant, form, f)
        return f

    return add


def names_of(form: str | None = None) -> list[str]:
    return [r.name for r in REGISTRY.values() if form in (None, r.form)]


def restricted(m: Instance, repos: DataFrame) -> Instance:
    """The instance of the named repositories (repo) alone."""
    return Instance(*[df if df is None else df.join(repos, "repo", "left_semi") for df in m])


def up(m: Instance) -> DataFrame:
    """The closure of the parents."""
    return m.closure if m.closure is not None else graph.ancestors(m.parents)


def first_up(m: Instance) -> DataFrame:
    """The closure of the first parents."""
    return m.chain if m.chain is not None else graph.ancestors(graph.first_parent(m.parents))


def local_of(m: Instance) -> DataFrame:
    """Local methods of classes with their columns: repo cls method and those of `method`, and their key."""
    return m.local if m.local is not None else _keyed(m.local_methods.join(m.method, ["method", "repo"]))


def inherited_of(m: Instance) -> DataFrame:
    return m.inherited if m.inherited is not None else _keyed(m.inherited_methods.join(m.method, ["method", "repo"]))


def _keyed(members: DataFrame) -> DataFrame:
    return members.withColumn("key", method_key(F.col("member_name"), F.col("param_types")))


TUPLES = ("local", "inherited", "binding")


def _members(m: Instance, tuples: tuple[str, ...], forms: bool) -> DataFrame:
    atoms = {"local": m.local_methods, "inherited": m.inherited_methods, "binding": whole_bindings(m).select("repo", F.col("implementer").alias("cls"), F.col("target").alias("method"), "binding")}
    rows = None
    for name in tuples:
        rel = atoms[name].select("repo", "method", "cls", F.lit(name).alias("relation"), (_c("binding") if name == "binding" else F.lit(None).cast("string")).alias("binding"))
        rows = rel if rows is None else rows.unionByName(rel)
    pair = Window.partitionBy("method", "repo", "cls")
    rows = rows.repartition("method", "repo").select("*", *[F.count_if(F.col("relation") == name).over(pair).alias(n) for name, n in zip(TUPLES, ("n_local", "n_inherited", "n_bound"))])
    rows = rows.withColumn("n_owners", F.count_if(F.col("relation") == "local").over(Window.partitionBy("method", "repo")))
    if not forms:
        return rows.withColumn("form", F.lit(1))
    of = Window.partitionBy("method", "repo").orderBy("is_abstract")
    flagged = lambda v: F.count_if(F.col("is_abstract") == v).over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    each = m.method.select("*", F.row_number().over(of).alias("form"), flagged("Yes").alias("n_abstract"))
    return rows.join(each, ["method", "repo"], "left").withColumn("n_abstract", F.coalesce("n_abstract", F.lit(0)))


def members_of(m: Instance, tuples: tuple[str, ...] = TUPLES, forms: bool = True) -> DataFrame:
    """The local and inherited tuples of methods and the whole bindings, side by side: repo, method, cls (of a binding the
    implementer), relation, binding, in how many rows of each relation that class and method are (n_local, n_inherited,
    n_bound), and how many local tuples the method is in (n_owners). With `forms`, also the method's columns, the number of
    its row (form, null without one) and how many of its rows are abstract (n_abstract).

    All are dealt once, by their method. `tuples` names the relations that the caller reads; others may be left out."""
    return m.members if m.members is not None else _members(m, tuples, forms)


#: A row for each tuple, also of a method that has several rows.
ONCE = "coalesce(form, 1) = 1"


def _of_members(name: str, *names: str) -> Callable[[Instance], DataFrame]:
    """The tuples of a relation from `members`: those of known methods with their columns and key, or without `names`
    all of them."""
    def tuples(m: Instance) -> DataFrame:
        rows = m.members.filter(F.col("relation") == name)
        if names:
            return rows.filter(ONCE).select(*names)
        return _keyed(rows.filter("form IS NOT NULL").select("repo", "method", "cls", *[c for c in m.method.columns if c not in ("repo", "method")]))

    return tuples


def _once(name: str) -> cached_property:
    return cached_property(lambda m: written(m[Instance._fields.index(name)], name))


class Prepared(Instance):
    """An instance for several rules: what more than one of them reads is computed when it is first asked for, and once."""

    binding, inherited_attributes = map(_once, ("binding", "inherited_attributes"))
    members = cached_property(lambda m: written(_members(Instance(*m), TUPLES, True), "members"))
    body_counts = cached_property(lambda m: written(_body_counts(m), "bodies"))
    closure = cached_property(lambda m: graph.ancestors(m.parents))
    chain = cached_property(lambda m: graph.ancestors(graph.first_parent(m.parents)))
    local_methods, inherited_methods = (cached_property(_of_members(n, "repo", "cls", "method")) for n in ("local", "inherited"))
    local, inherited = (cached_property(_of_members(n)) for n in ("local", "inherited"))


def repeated(rows: DataFrame, keys: list[str], item: str, order: str = "ord") -> DataFrame:
    """Groups of more than one row, with their items in order, comma-joined, as `who`; only these are sorted. The groups are
    told by a count, so that a report which asks only for their number collects no items."""
    g = rows.groupBy(*keys, "repo").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct(order, item)).alias("all")).filter("n > 1")
    return g.select("repo", *keys, F.array_join(F.transform(F.array_sort("all"), lambda x: x[item]), ", ").alias("who"))


def shown(df: DataFrame, subject: Column, *text: Column | str) -> DataFrame:
    return df.select("repo", subject.alias("subject"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("description"))


def _c(name: str) -> Column:
    return F.col(name)


@rule("chk_duplicate_names", "IdentifierIntegrity")
def duplicate_names(m: Instance) -> DataFrame:
    """Classes without a name are alike in none."""
    g = repeated(m.classifier.filter(_c("name").isNotNull()), ["name"], "cls")
    return shown(g, _c("name"), "Duplicate name '", _c("name"), "' used by: ", _c("who"))


@rule("chk_duplicate_ids", "IdentifierIntegrity")
def duplicate_ids(m: Instance) -> DataFrame:
    """One violation for each atom whose id another before it has, with the last such one."""
    parts = []
    for df, kind, ident, atom in ((m.classifier, "Classifier", "cid", "cls"), (m.method, "Method", "mid", "method"), (m.attribute, "Attribute", "aid", "attribute")):
        before = F.lag(atom).over(Window.partitionBy(ident, "repo").orderBy("ord", atom))
        g = df.filter(_c(ident).isNotNull()).select("repo", ident, atom, before.alias("before")).filter("before IS NOT NULL")
        parts.append(shown(g, _c(ident), f"Duplicate {kind}ID ", _c(ident), " on ", _c("before"), " and ", _c(atom)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@rule("chk_exclusive_owner", "ExclusiveDeclarationOwnership")
def exclusive_owner(m: Instance) -> DataFrame:
    parts = []
    methods = m.local_methods if m.members is None else m.members.filter("relation = 'local' AND n_owners > 1")
    for df, kind, atom in ((methods, "Method", "method"), (m.local_attributes, "Attribute", "attribute")):
        g = df.groupBy("repo", atom).agg(F.array_sort(F.collect_set("cls")).alias("who")).filter(F.size("who") > 1)
        parts.append(shown(g, _c(atom), f"{kind} ", _c(atom), " declared in multiple classifiers: [", F.array_join("who", ", "), "]"))
    return parts[0].unionByName(parts[1])


@rule("chk_cycle", "AcyclicGeneralization")
def cycle(m: Instance) -> DataFrame:
    return shown(graph.on_cycles(m.parents), _c("cls"), "Cyclic inheritance involving ", _c("cls"))


@rule("chk_inherited_private", "InheritedMemberDerivation")
def inherited_private(m: Instance) -> DataFrame:
    a = inherited_of(m).filter(_c("is_inheritable") == "No").select("repo", "cls", "method")
    b = m.inherited_attributes.join(m.attribute.filter(_c("is_inheritable") == "No").select("repo", "attribute"), ["attribute", "repo"])
    return shown(a, _c("method"), "Private method ", _c("method"), " appears in inheritedMethods of ", _c("cls")).unionByName(
        shown(b, _c("attribute"), "Private attribute ", _c("attribute"), " appears in inheritedAttributes of ", _c("cls"))
    )


@rule("chk_local_inherited_disjoint", "LocalInheritedSeparation")
def local_inherited_disjoint(m: Instance) -> DataFrame:
    a = members_of(m, ("local", "inherited"), False).filter("n_local > 0 AND n_inherited > 0").select("repo", "cls", "method").distinct()
    b = m.local_attributes.intersect(m.inherited_attributes)
    return shown(a, _c("method"), "Method ", _c("method"), " appears in both localMethods and inheritedMethods of ", _c("cls")).unionByName(
        shown(b, _c("attribute"), "Attribute ", _c("attribute"), " appears in both localAttributes and inheritedAttributes of ", _c("cls"))
    )


def _body_counts(m: Instance) -> DataFrame:
    n = m.binding.groupBy("body", "repo").agg(F.count(F.lit(1)).alias("n"))
    return m.body.join(n, ["body", "repo"], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n <> 1").select("repo", "body", "n")


def body_counts_of(m: Instance) -> DataFrame:
    """Bodies that have not exactly one binding: repo, body, n."""
    return m.body_counts if m.body_counts is not None else _body_counts(m)


def bound_repos(m: Instance, rows: DataFrame) -> DataFrame:
    """Rows of repositories with a binding: the checker leaves its binding rules out of others."""
    return rows.join(m.binding.filter(_c("implementer").isNotNull()).select("repo").distinct(), "repo", "left_semi")


@rule("chk_orphan_body", "ImplementationBindingPolicy")
def orphan_body(m: Instance) -> DataFrame:
    return shown(bound_repos(m, body_counts_of(m).filter("n = 0")), _c("body"), "Orphan MethodBody ", _c("body"), " has no ImplementationBinding")


def available_members(m: Instance) -> DataFrame:
    """Local and inherited methods of each class: repo, cls, method."""
    return m.local_methods.unionByName(m.inherited_methods).distinct()


def whole_bindings(m: Instance) -> DataFrame:
    """Bindings that name an implementer and a target; the checker passes over others."""
    return m.binding.filter(_c("implementer").isNotNull() & _c("target").isNotNull())


def _bound(members: DataFrame, condition: str) -> DataFrame:
    """The bindings among members for which a condition holds: repo, implementer, target, binding."""
    rows = members.filter(F.col("relation") == "binding").filter(ONCE).filter(condition)
    return rows.select("repo", F.col("cls").alias("implementer"), F.col("method").alias("target"), "binding")


@rule("chk_binding_target", "ImplementationBindingPolicy")
def binding_target(m: Instance) -> DataFrame:
    bad = _bound(members_of(m, forms=False), "n_local = 0 AND n_inherited = 0")
    return shown(bad, _c("binding"), "ImplementationBinding ", _c("binding"), " targets method ", _c("target"), " not available in ", _c("implementer"))


@rule("chk_abstract_has_body", "ImplementationBindingPolicy")
def abstract_has_body(m: Instance) -> DataFrame:
    bad = _bound(members_of(m, ("local", "binding")), "n_local > 0 AND n_abstract > 0")
    return shown(bad, _c("target"), "Abstract method ", _c("target"), " has a body via ", _c("binding"), " in declaring class ", _c("implementer"))


@rule("chk_multiple_bindings", "ImplementationBindingPolicy")
def multiple_bindings(m: Instance) -> DataFrame:
    g = repeated(_bound(members_of(m, ("binding",), False), "n_bound > 1"), ["implementer", "target"], "binding", "repo")
    return shown(g, _c("target"), "Multiple bindings for ", _c("implementer"), "::", _c("target"), ": [", _c("who"), "]")


@rule("chk_missing_binding", "ImplementationBindingPolicy")
def missing_binding(m: Instance) -> DataFrame:
    rows = members_of(m, ("local", "binding")).filter("relation = 'local' AND is_abstract = 'No' AND n_bound = 0").select("repo", "cls", "method")
    return shown(bound_repos(m, rows), _c("method"), "Non-abstract method ", _c("method"), " in ", _c("cls"), " has no ImplementationBinding")


def _sought(need: DataFrame, m: Instance, chain: DataFrame) -> DataFrame:
    """The rows of `need` (repo, cls, method) with `any`, whether the method has a binding, and `seen`, whether it has one by
    the class or one of its `chain`. `need` is read once; pairs that the class itself binds may be left out of it, being seen."""
    bound = m.binding.select("repo", F.col("target").alias("method"), F.col("implementer").alias("anc")).repartition("method", "repo").distinct().withColumn("any", F.lit(True))
    above = chain.select("repo", "cls", "anc", F.lit(True).alias("above"))
    met = need.join(bound, ["method", "repo"], "left").join(above, ["cls", "anc", "repo"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return met.groupBy("repo", "cls", "method").agg(F.max(no(_c("any"))).alias("any"), F.max(no(_c("above")) | no(_c("cls") == _c("anc"))).alias("seen"))


#: Available members that their class does not bind itself.
UNBOUND = "relation <> 'binding' AND n_bound = 0"


def _concrete(m: Instance) -> DataFrame:
    return m.classifier.filter(F.coalesce(_c("is_abstract"), F.lit("")) != "Yes").select("repo", "cls")


@rule("chk_unresolved", "AbstractionPolicy")
def unresolved(m: Instance) -> DataFrame:
    """Available methods, not abstract, of classes that are not abstract: without any binding, or without one by the
    class or an ancestor by first parents."""
    need = members_of(m).filter(UNBOUND).filter("n_abstract = 0").select("repo", "cls", "method").join(_concrete(m), ["cls", "repo"])
    text = F.when(_c("any"), " with no ImplementationBinding visible in ancestor chain").otherwise(" without any ImplementationBinding")
    return shown(_sought(need, m, first_up(m)).filter(~_c("seen")), _c("method"), "Non-abstract classifier ", _c("cls"), " has non-abstract method ", _c("method"), text)


@rule("spec_unresolved", "AbstractionPolicy", "spec")
def spec_unresolved(m: Instance) -> DataFrame:
    """Available methods, also abstract ones, that no class of the ancestry by all parents, the class included, implements."""
    need = members_of(m, forms=False).filter(UNBOUND).select("repo", "cls", "method").join(m.classifier.filter(_c("is_abstract") == "No").select("repo", "cls"), ["cls", "repo"])
    return shown(_sought(need, m, up(m)).filter(~_c("seen")), _c("method"), "Non-abstract classifier ", _c("cls"), " has method ", _c("method"), " that no class of its ancestry implements")


@rule("chk_abstract_in_concrete", "AbstractionPolicy")
def abstract_in_concrete(m: Instance) -> DataFrame:
    concrete = m.classifier.filter(_c("is_abstract") != "Yes").select("repo", "cls")
    bad = local_of(m).filter(_c("is_abstract") == "Yes").select("repo", "cls", "method").join(concrete, ["cls", "repo"])
    return shown(bad, _c("method"), "Non-abstract classifier ", _c("cls"), " contains abstract method ", _c("method"))


@rule("chk_static_abstract", "StaticMethodPolicy")
def static_abstract(m: Instance) -> DataFrame:
    bad = m.method.filter((_c("scope") == "Static") & (_c("is_abstract") == "Yes"))
    return shown(bad, _c("method"), "Method ", _c("method"), " is both static and abstract")


def _namespace(members: DataFrame, atom: str, key: Column, text: str) -> DataFrame:
    """Classes with several members of one key; members without one are passed over."""
    keyed = members.select("repo", "cls", atom, "ord", key.alias("key")).filter(_c("key").isNotNull())
    return shown(repeated(keyed, ["cls", "key"], atom), _c("cls"), f"{text} '", _c("key"), "' in ", _c("cls"), ": [", _c("who"), "]")


def exact_key() -> Column:
    """The key of the specification: parameter types in order, null without name or types."""
    return F.concat(_c("member_name"), F.lit("("), _c("param_types"), F.lit(")"))


@rule("chk_local_namespace", "LocalMethodNamespace")
def local_namespace(m: Instance) -> DataFrame:
    return _namespace(local_of(m), "method", _c("key"), "Duplicate method key")


@rule("spec_local_namespace", "LocalMethodNamespace", "spec")
def spec_local_namespace(m: Instance) -> DataFrame:
    return _namespace(local_of(m), "method", exact_key(), "Duplicate method signature")


@rule("chk_local_attr_namespace", "LocalAttributeNamespace", "spec")
def local_attr_namespace(m: Instance) -> DataFrame:
    return _namespace(m.local_attributes.join(m.attribute, ["attribute", "repo"]), "attribute", _c("member_name"), "Duplicate attribute name")


@rule("chk_inherited_method_conflict", "InheritedConflictPolicy")
def inherited_method_conflict(m: Instance) -> DataFrame:
    return _namespace(inherited_of(m), "method", _c("key"), "Inherited method conflict key")


@rule("spec_inherited_method_conflict", "InheritedConflictPolicy", "spec")
def spec_inherited_method_conflict(m: Instance) -> DataFrame:
    return _namespace(inherited_of(m), "method", exact_key(), "Inherited method conflict signature")


@rule("chk_inherited_attr_conflict", "InheritedConflictPolicy")
def inherited_attr_conflict(m: Instance) -> DataFrame:
    return _namespace(m.inherited_attributes.join(m.attribute, ["attribute", "repo"]), "attribute", _c("member_name"), "Inherited attribute conflict")


#: What an override repeats.
SIGNATURE = ["member_name", "param_types", "scope"]


def overridable(m: Instance) -> DataFrame:
    """Inheritable local methods: repo, anc, base, base_type and their signature."""
    return local_of(m).filter(_c("is_inheritable") == "Yes").select("repo", F.col("cls").alias("anc"), F.col("method").alias("base"), F.col("return_type").alias("base_type"), *SIGNATURE)


def subtypes(m: Instance, pairs: DataFrame) -> DataFrame:
    """The rows of `pairs` (repo, sub, super) that name classes of which the first is the second or has it among its
    ancestors by first parents."""
    names = m.classifier.select("repo", "name", "cls")
    met = pairs.join(names.withColumnRenamed("name", "sub"), ["sub", "repo"])
    met = met.join(names.select("repo", F.col("name").alias("super"), F.col("cls").alias("anc")), ["super", "repo"])
    same = met.filter(_c("cls") == _c("anc")).select("repo", "sub", "super")
    return same.unionByName(met.join(first_up(m), ["cls", "anc", "repo"], "left_semi").select("repo", "sub", "super")).distinct()


@rule("chk_override_return", "OverridePolicy")
def override_return_covariant(m: Instance) -> DataFrame:
    """Local methods whose return type is neither that of an inherited method of their key and scope nor a subtype of it;
    and overrides, not abstract, in atoms that are no classifiers."""
    local = local_of(m).filter(_c("key").isNotNull()).select("repo", "cls", "method", "key", "scope", "return_type", "is_abstract")
    above = inherited_of(m).filter(_c("key").isNotNull()).select("repo", "cls", "key", F.col("method").alias("base"), F.col("scope").alias("base_scope"), F.col("return_type").alias("base_type"))
    met = local.join(above, ["cls", "key", "repo"]).filter(_c("scope").isNull() | (_c("scope") == _c("base_scope")))
    met = met.join(m.classifier.select("repo", "cls", F.lit(True).alias("named")).distinct(), ["cls", "repo"], "left")
    alone = _c("named").isNull() & (F.coalesce(_c("is_abstract"), F.lit("")) != "Yes")
    met = written(met.select("repo", "cls", "method", "return_type", "base", "base_type", alone.alias("alone")).filter(_c("alone") | (_c("return_type") != _c("base_type"))), "overrides")
    differ = met.filter(_c("return_type") != _c("base_type"))
    pairs = differ.select("repo", F.col("return_type").alias("sub"), F.col("base_type").alias("super")).distinct()
    fine = subtypes(m, pairs).select("repo", F.col("sub").alias("return_type"), F.col("super").alias("base_type"))
    bad = differ.join(fine, ["return_type", "base_type", "repo"], "left_anti")
    lone = met.filter("alone")
    return shown(bad, _c("method"), "Override ", _c("method"), " (returnType ", _c("return_type"), ") in ", _c("cls"), " is not a subtype of inherited ", _c("base"), " (returnType ", _c("base_type"), ")").unionByName(
        shown(lone, _c("method"), "Override ", _c("method"), " in ", _c("cls"), " is non-abstract but classifier is not a Class")
    )


@rule("spec_override_return", "OverridePolicy", "spec")
def override_return(m: Instance) -> DataFrame:
    """Only signatures with several return types in their repository are looked up among ancestors: no others can differ."""
    local = local_of(m).select("repo", "cls", "method", "return_type", *SIGNATURE)
    several = local.select("repo", *SIGNATURE, "return_type").filter(_c("return_type").isNotNull()).distinct().groupBy("repo", *SIGNATURE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    several = written(several, "signatures")
    mixed = lambda rows: rows.join(several, [*SIGNATURE, "repo"], "left_semi")
    met = mixed(local).join(up(m).join(mixed(overridable(m)), ["anc", "repo"]), ["cls", *SIGNATURE, "repo"])
    bad = met.filter(_c("return_type") != _c("base_type")).select("repo", "cls", "method", "return_type", "base", "base_type").distinct()
    return shown(bad, _c("method"), "Override ", _c("method"), " (returnType ", _c("return_type"), ") in ", _c("cls"), " differs from overridden ", _c("base"), " (returnType ", _c("base_type"), ")")


@rule("spec_override_implemented", "OverridePolicy", "spec")
def override_implemented(m: Instance) -> DataFrame:
    """Only methods that are neither abstract nor bound are looked up among ancestors."""
    need = members_of(m, ("local", "binding")).filter("relation = 'local' AND is_abstract = 'No' AND n_bound = 0").select("repo", "cls", "method", *SIGNATURE).distinct()
    met = need.join(up(m), ["cls", "repo"]).join(overridable(m).select("repo", "anc", *SIGNATURE), ["anc", *SIGNATURE, "repo"], "left_semi")
    return shown(met.select("repo", "cls", "method").distinct(), _c("method"), "Override ", _c("method"), " in ", _c("cls"), " is neither abstract nor implemented")


@rule("spec_owner_count", "ExclusiveDeclarationOwnership", "spec")
def owner_count(m: Instance) -> DataFrame:
    """Members that have not exactly one owner, also those without any."""
    parts = []
    for atoms, tuples, kind, atom in ((m.method, m.local_methods, "Method", "method"), (m.attribute, m.local_attributes, "Attribute", "attribute")):
        n = tuples.groupBy("repo", atom).agg(F.count_distinct("cls").alias("n"))
        g = atoms.select("repo", atom).join(n, [atom, "repo"], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n <> 1")
        parts.append(shown(g, _c(atom), f"{kind} ", _c(atom), " has ", _c("n").cast("string"), " owners"))
    return parts[0].unionByName(parts[1])


def _view(m: Instance, atoms: DataFrame, local: DataFrame, tuples: DataFrame, atom: str, key: list[str], relation: str) -> DataFrame:
    """What differs between the `tuples` of inherited members and the view derived from the local ones."""
    own = local.join(atoms, [atom, "repo"]).select("repo", "cls", F.col(atom).alias("member"), (_c("is_inheritable") == "Yes").alias("inheritable"), *key)
    sides = [(inherited_rows(up(m), own, key), False), (tuples.select("repo", "cls", F.col(atom).alias("member")), True)]
    rows = [df.select("repo", "cls", "member", F.lit(given).alias("given")) for df, given in sides]
    met = rows[0].unionByName(rows[1]).groupBy("repo", "cls", "member").agg(F.max("given").alias("given"), F.min("given").alias("only"))
    met = met.filter(_c("given") == _c("only"))
    text = F.when(_c("given"), F.concat(F.lit(f" in {relation} of "), _c("cls"), F.lit(" is not derived"))).otherwise(F.concat(F.lit(f" is missing from {relation} of "), _c("cls")))
    return shown(met, _c("member"), _c("member"), text)


@rule("spec_inherited_methods", "InheritedMemberDerivation", "spec")
def inherited_methods_view(m: Instance) -> DataFrame:
    return _view(m, m.method, m.local_methods, m.inherited_methods, "method", ["member_name", "param_types"], "inheritedMethods")


@rule("spec_inherited_attributes", "InheritedMemberDerivation", "spec")
def inherited_attributes_view(m: Instance) -> DataFrame:
    return _view(m, m.attribute, m.local_attributes, m.inherited_attributes, "attribute", ["member_name"], "inheritedAttributes")


@rule("spec_body_count", "ImplementationBindingPolicy", "spec")
def body_count(m: Instance) -> DataFrame:
    """Bodies that have not exactly one binding."""
    return shown(body_counts_of(m), _c("body"), "MethodBody ", _c("body"), " has ", _c("n").cast("string"), " bindings")


@rule("spec_binding_count", "ImplementationBindingPolicy", "spec")
def binding_count(m: Instance) -> DataFrame:
    """Local methods, not abstract, that have not exactly one binding by their class."""
    g = members_of(m, ("local", "binding")).filter("relation = 'local' AND is_abstract = 'No' AND n_bound <> 1")
    return shown(g, _c("method"), "Method ", _c("method"), " in ", _c("cls"), " has ", _c("n_bound").cast("string"), " bindings")


@rule("spec_abstract_instances", "AbstractNoDirectInstances", "spec")
def abstract_instances(m: Instance) -> DataFrame:
    bad = m.objects.join(m.classifier.filter(_c("is_abstract") == "Yes").select("repo", "cls"), ["cls", "repo"])
    return shown(bad, _c("object"), "Abstract classifier ", _c("cls"), " has direct instance ", _c("object"))


@rule("spec_object_classes", "ObjectsInOneClass", "spec")
def object_classes(m: Instance) -> DataFrame:
    g = m.objects.groupBy("repo", "object").agg(F.count_distinct("cls").alias("n")).filter("n > 1")
    return shown(g, _c("object"), "Object ", _c("object"), " belongs to ", _c("n").cast("string"), " classifiers")


@rule("spec_unique_oids", "UniqueOids", "spec")
def unique_oids(m: Instance) -> DataFrame:
    g = m.objects.groupBy("repo", "oid").agg(F.count_distinct("object").alias("n")).filter("n > 1")
    return shown(g, _c("oid"), "ObjectID ", _c("oid"), " is of ", _c("n").cast("string"), " objects")


def broken(m: Instance) -> DataFrame:
    """Repositories that the checker cannot finish, with the reason: (repo, description).

    Its override rule fails on a local method without a name in a class that inherits a method.
    """
    nameless = m.local_methods.join(m.method.filter(_c("member_name").isNull()).select("repo", "method"), ["method", "repo"], "left_semi")
    heirs = m.inherited_methods.join(m.method.select("repo", "method"), ["method", "repo"], "left_semi").select("repo", "cls").distinct()
    found = nameless.join(heirs, ["cls", "repo"], "left_semi")
    return found.groupBy("repo").agg(F.concat(F.lit("Method without a name: "), F.min("method")).alias("description"))


OF_OBJECTS = ("spec_abstract_instances", "spec_object_classes", "spec_unique_oids")


def violations(m: Instance, names: list[str] | None = None) -> DataFrame:
    """The violations of the named rules (all): repo, invariant, check_name, subject, description.

    What several of them read is computed once; rules of objects are left out of an instance without any.
    """
    m, out = Prepared(*m), None
    for r in (REGISTRY[n] for n in names or REGISTRY):
        if m.objects is None and r.name in OF_OBJECTS:
            continue
        rows = r.check(m).select("repo", F.lit(r.invariant).alias("invariant"), F.lit(r.name).alias("check_name"), "subject", "description")
        out = rows if out is None else out.unionByName(rows)
    return out


def verdicts(found: DataFrame, repos: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """SAT, UNSAT or ERROR and the number of violations for each repository, also for those without any.

    `errors` (repo, description), see `broken`: such a repository loses its violations and has the error alone.
    """
    n = found.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    joined = repos.select("repo").distinct().join(n, "repo", "left")
    result = F.when(F.col("n") > 0, "UNSAT").otherwise("SAT")
    if errors is None:
        return joined.select("repo", result.alias("result"), F.coalesce("n", F.lit(0)).alias("n_violations"))
    joined = joined.join(errors.select("repo", F.lit(True).alias("failed")), "repo", "left")
    failed = F.col("failed").isNotNull()
    return joined.select("repo", F.when(failed, "ERROR").otherwise(result).alias("result"), F.when(failed, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_violations"))


def known(found: DataFrame, names: list[str]) -> DataFrame:
    """The violations of invariants that are in `names`."""
    return found.filter(F.col("invariant").isin(names))
