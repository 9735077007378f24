"""Classification of names, paths and edge kinds for the map views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered (label, pattern) rules; the first match wins.
BAND_RULES = (
    ("Controller", r"controller|router|route|handler|api"),
    ("Service", r"service|usecase|use_case|manager|orchestrat"),
    ("Repository", r"repository|repo|dao|store|gateway"),
    ("Entity", r"entity|model|domain|schema"),
)
BANDS = ("Controller", "Service", "Repository", "Entity")
TIERS = ("Frontend", "Backend", "Database")
TIER_TOP_RULES = (
    ("Frontend", r"^(frontend|client|web|webapp|ui|app|spa|mobile|ios|android|public|static|pages|views)"),
    ("Backend", r"^(backend|server|api|services|core|lib|src|internal)"),
    ("Database", r"^(db|database|sql|migrations|schema|prisma|sqlite|postgres|mongo|fixtures|seeds)"),
)
TIER_PATH_RULES = (
    ("Frontend", r"\b(frontend|client|web|webapp|react|vue|svelte|angular|next|tsx|jsx)\b"),
    ("Backend", r"\b(backend|server|api|fastapi|express|django|flask|spring)\b"),
    ("Database", r"\b(database|sql|prisma|migration|schema|orm|sqlite|postgres|mongo)\b"),
)
LAYER_RULES = (
    ("Persistence layer", r"repository|repo|dao|persistence|store|model|orm|migration"),
    ("API layer", r"api|controller|router|handler|http|rest|graphql"),
    ("Presentation layer", r"view|component|page|ui|client"),
    ("Infrastructure layer", r"infra|gateway|adapter"),
)
RELATION_RULES = (
    ("inheritance", r"(^|_)(inherits?|extends|generaliz)"),
    ("realization", r"implements?|realiz"),
    ("composition", r"composes|composition|owns"),
    ("aggregation", r"aggregat|contains|has_a|has-a|hasa"),
    ("association", r"calls?|references?|uses?|associat|invokes?|reads?|writes?"),
)
GUESS_RULES = (
    ("frontend", r"(\b|/)(ui|components?|frontend|client|web|pages?|views?)(\b|/)"),
    ("data", r"(\b|/)(db|database|sql|repository|repo|model|orm|migrations?|schema)(\b|/)"),
    ("backend", r"(\b|/)(api|server|backend|service|controller|router|handler)(\b|/)"),
)
DRILL_RULES = (
    ("Controller", r"controller|handler|router|view|page|api", r"(controllers?|handlers?|routes?|views?|pages?|api)/"),
    ("Repository", r"repository|repo|dao|store|gateway", r"(repositor(y|ies)|daos?|stores?|gateways?)/"),
    ("Entity", r"entity|model|schema|dto|domain", r"(entit(y|ies)|models?|schemas?|dto|domain)/"),
)
CONTEXT_SKIP = (
    r"controller|handler|router|routes?|view|page|api|service|manager|usecase|workflow|repository|repo|dao"
    r"|store|gateway|entity|model|schema|dto|domain"
)


def first_rule(text: Column, rules, default: str) -> Column:
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def node_class(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(k == "class", "class")
        .when(k.isin("interface", "type"), "interface")
        .when(k.isin("module", "file", "package", "cluster"), "module")
        .otherwise("function")
    )


def band(label: Column, path: Column) -> Column:
    return first_rule(F.lower(F.concat(label, F.lit(" "), F.coalesce(path, F.lit("")))), BAND_RULES, "Service")


def tier(path: Column) -> Column:
    p = F.lower(F.coalesce(path, F.lit("")))
    top = F.coalesce(F.try_element_at(F.filter(F.split(p, "/"), lambda s: s != ""), F.lit(1)), F.lit(""))
    by_ext = (
        F.when(p.rlike(r"\.(tsx|jsx|vue|svelte|html|css|scss)$"), "Frontend")
        .when(p.rlike(r"\.(sql|prisma)$"), "Database")
        .otherwise("Backend")
    )
    # The order the rules are tried in is Frontend, Backend, Database.
    by_path = by_ext
    for label, pattern in reversed(TIER_PATH_RULES):
        by_path = F.when(p.rlike(pattern), label).otherwise(by_path)
    by_top = by_path
    for label, pattern in reversed(TIER_TOP_RULES):
        by_top = F.when(top.rlike(pattern), label).otherwise(by_top)
    return F.when(p == "", "Backend").otherwise(by_top)


def layer_of_cluster(cluster_id: Column) -> Column:
    return first_rule(F.lower(cluster_id), LAYER_RULES, "External")


def relation(edge_kind: Column) -> Column:
    return first_rule(F.lower(F.coalesce(edge_kind, F.lit(""))), RELATION_RULES, "dependency")


def tier_guess(name: Column, cluster: Column, path: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (path, cluster, name)]))
    return first_rule(blob, GUESS_RULES, "unknown")


def protocol(source_tier: Column, target_tier: Column, target_name: Column) -> Column:
    n = F.lower(target_name)
    return (
        F.when(source_tier == target_tier, F.lit(None).cast("string"))
        .when(target_tier == "data", "«SQL»")
        .when((target_tier == "backend") & (source_tier == "frontend"), "«HTTP»")
        .when((source_tier == "backend") & (target_tier == "frontend"), "«HTTP»")
        .when(n.rlike("query|select|insert|update|delete|sql"), "«SQL»")
        .when(n.rlike("fetch|axios|request|http|get|post"), "«HTTP»")
        .otherwise("«crosses tier»")
    )


def drill_band(name: Column, path: Column) -> Column:
    n, p = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    out = F.lit("Service")
    for label, by_name, by_path in reversed(DRILL_RULES):
        out = F.when(n.rlike(by_name) | p.rlike(by_path), label).otherwise(out)
    return out


def drill_context(path: Column, skip: int) -> Column:
    """First directory after `skip` parts that is not a layer word; null when none."""
    dirs = F.filter(F.split(path, "/"), lambda s: s != "")
    inner = F.slice(dirs, skip + 1, F.greatest(F.size(dirs) - 1 - skip, F.lit(0)))
    return F.try_element_at(F.filter(inner, lambda s: ~F.lower(s).rlike(CONTEXT_SKIP)), F.lit(1))


# Names of the agents that answer each query type.
AGENT_NAMES = {
    "find_relevant_context": "Coordinator",
    "trace_data_flow": "Flow Analyst",
    "find_invariants": "Invariant Reporter",
    "describe_architecture": "Architecture Analyst",
    "find_exemplars": "Exemplar Finder",
}


def agent_label(query_type: Column) -> Column:
    """Agent of a query type; other types stand for themselves."""
    name = query_type
    for kind, label in AGENT_NAMES.items():
        name = F.when(query_type == kind, label).otherwise(name)
    return name
