"""The rule catalog: fields, schemas and conditions as small dimension tables.

A catalog is data and comes by path (YAML or JSON) or as a mapping; nothing of it is built in.  Its shape:
fields [{id, label, repeatable, value_type}], schemas [{id, section, family, medium, required_fields,
conditional_fields, ordered_fields, conditions [{any_of} or {when_field_present, then_required}]}],
output_policy {doi_url_deduplication, distinct_url_with_doi, network_access}.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_ID = r"[a-z]+\.\d+(?:_\d+)?"


@dataclass(frozen=True)
class Catalog:
    payload: dict

    @classmethod
    def load(cls, source: str | dict) -> Catalog:
        """Read and check a catalog; raises ValueError with all that is wrong."""
        if isinstance(source, dict):
            payload = source
        else:
            text = Path(source).read_text(encoding="utf-8")
            if str(source).endswith(".json"):
                payload = json.loads(text)
            else:
                import yaml

                payload = yaml.safe_load(text)
        if not isinstance(payload, dict):
            raise ValueError("a catalog is a mapping")
        catalog = cls(payload)
        if wrong := catalog.errors():
            raise ValueError("; ".join(wrong))
        return catalog

    @property
    def fields(self) -> list[dict]:
        return self.payload.get("fields", [])

    @property
    def schemas(self) -> list[dict]:
        return self.payload.get("schemas", [])

    @property
    def policy(self) -> dict:
        return {"doi_url_deduplication": True, "distinct_url_with_doi": True} | self.payload.get("output_policy", {})

    def errors(self) -> list[str]:
        found = []
        known = [f["id"] for f in self.fields]
        ids = [s["id"] for s in self.schemas]
        for what, values in (("field", known), ("schema", ids), ("section", [s.get("section") for s in self.schemas if s.get("section")]), ("rule", [r["id"] for r in self.payload.get("general_rules", [])])):
            found += [f"{what} {v} stands twice" for v in sorted({v for v in values if values.count(v) > 1})]
        for s in self.schemas:
            if not re.fullmatch(SCHEMA_ID, s["id"]):
                found.append(f"{s['id']} is no schema id")
            required, conditional, ordered = (s.get(k, []) for k in ("required_fields", "conditional_fields", "ordered_fields"))
            if set(required) & set(conditional):
                found.append(f"{s['id']}: fields both required and conditional")
            if any(len(x) != len(set(x)) for x in (required, conditional, ordered)):
                found.append(f"{s['id']}: a field stands twice")
            if set(ordered) != set(required) | set(conditional):
                found.append(f"{s['id']}: ordered fields aren't the declared ones")
            named = {*required, *conditional}
            for c in s.get("conditions", []):
                if bool(c.get("any_of")) == (c.get("when_field_present") is not None):
                    found.append(f"{s['id']}: a condition is either any_of or when_field_present")
                elif c.get("when_field_present") is not None and not c.get("then_required"):
                    found.append(f"{s['id']}: when_field_present needs then_required")
                named |= {*c.get("any_of", []), *c.get("then_required", []), *([c["when_field_present"]] if c.get("when_field_present") else [])}
            if unknown := sorted(named - set(known)):
                found.append(f"{s['id']}: unknown fields {', '.join(unknown)}")
        if self.payload.get("output_policy", {}).get("network_access"):
            found.append("network access isn't allowed")
        return found

    def report(self) -> dict:
        return {"fields": len(self.fields), "schemas": len(self.schemas), "families": len({s["family"] for s in self.schemas}), "electronic": sum(s["medium"] == "electronic" for s in self.schemas), "rules": len(self.payload.get("general_rules", [])), "errors": self.errors(), "valid": not self.errors()}

    def schema_id(self, family: str, medium: str) -> str | None:
        return next((s["id"] for s in self.schemas if (s["family"], s["medium"]) == (family, medium)), None)

    # Dimension tables: at most one row for each field of each schema, so broadcasting them is bounded by the catalog.

    def dim_field(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f["id"], f.get("label"), bool(f.get("repeatable")), f.get("value_type")) for f in self.fields], "field_id string, label string, repeatable boolean, value_type string")

    def dim_schema(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s["id"], s["family"], s["medium"], s.get("label")) for s in self.schemas], "schema_id string, family string, medium string, schema_label string")

    def dim_schema_field(self, spark: SparkSession) -> DataFrame:
        rows = [(s["id"], f, i, f in s["required_fields"]) for s in self.schemas for i, f in enumerate(s["ordered_fields"])]
        return spark.createDataFrame(rows, "schema_id string, field_id string, ordinal int, required boolean")

    def dim_condition(self, spark: SparkSession) -> DataFrame:
        rows = [(s["id"], i, c.get("any_of") or None, c.get("when_field_present"), c.get("then_required") or None) for s in self.schemas for i, c in enumerate(s.get("conditions", []))]
        return spark.createDataFrame(rows, "schema_id string, condition int, any_of array<string>, when_field string, then_required array<string>")


def repeatable(dim_field: DataFrame) -> DataFrame:
    return dim_field.filter("repeatable").select("field_id", F.lit(True).alias("repeatable"))
