"""Rules over the resource graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.plans.settle import settled
from siltstone.sources.templates import Relations


def row(rule: str | Column, severity: str | Column, category: str, kind: str | Column, source: str, text: Column, resource: str = "logical_id") -> list:
    """The columns of a confirmed finding."""
    fixed = {"category": category, "type": kind, "severity": severity, "confidence": "Confirmed", "source": source, "rule_id": rule}
    return ["template_id", F.col(resource).alias("resource"), *[F.lit(x).alias(c) for c, x in fixed.items()], text.alias("finding")]


def findings(relations: Relations) -> DataFrame:
    """Detached gateways, tables without a default route, reachable databases, orphaned route tables."""
    net = lambda rule, severity, text: row(rule, severity, "NetworkSecurity", "Security", "Network Review", F.concat("logical_id", F.lit(text)))
    res, edges = relations.resources, settled(relations.edges())
    of = lambda t: res.where(F.col("type") == f"AWS::EC2::{t}").select("template_id", "logical_id")
    sources = lambda df: edges.join(df.select("template_id", F.col("logical_id").alias("src")), ["template_id", "src"], "left_semi").select("template_id", F.col("dst").alias("logical_id"))
    gateways = of("InternetGateway")
    loose = gateways.join(sources(of("VPCGatewayAttachment")), ["template_id", "logical_id"], "left_anti")
    default = relations.props.where("prop in ('Properties/DestinationCidrBlock', 'Properties/DestinationIpv6CidrBlock') and sval in ('0.0.0.0/0', '::/0')")
    routes = of("Route").join(default, ["template_id", "logical_id"], "left_semi")
    closed = of("RouteTable").join(gateways, "template_id", "left_semi").join(sources(routes), ["template_id", "logical_id"], "left_anti")
    public = relations.props.where("prop = 'Properties/PubliclyAccessible' and vtype = 'bool' and sval = 'true'")
    reachable = res.where("type = 'AWS::RDS::DBInstance'").join(public, ["template_id", "logical_id"], "left_semi").join(gateways, "template_id", "left_semi")
    orphans = of("RouteTable").join(edges.select("template_id", F.col("dst").alias("logical_id")), ["template_id", "logical_id"], "left_anti")
    parts = [
        loose.select(*net("igw_not_attached", "HIGH", ": the internet gateway is attached to no VPC")),
        closed.select(*net("route_table_no_default_route", "MEDIUM", ": the route table has no default route although there is an internet gateway")),
        reachable.select(*net("rds_reachable_from_internet", "HIGH", ": the database is public and the template has an internet gateway")),
        orphans.select(*net("orphaned_route_table", "LOW", ": nothing refers to the route table")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
