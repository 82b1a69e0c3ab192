"""The configuration: document types, fields and batch keys. It is compiled into Column expressions, so it stays on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class DocType:
    name: str
    keywords: tuple[str, ...] = ()
    weight: int = 5
    description: str = ""


@dataclass(frozen=True)
class FieldSpec:
    name: str
    extractor: str
    labels: tuple[str, ...] = ()
    #: None: every type, also Unknown; an empty tuple: no type.
    applies_to: tuple[str, ...] | None = None
    is_batch_key: bool = False
    description: str = ""


@dataclass(frozen=True)
class Config:
    types: tuple[DocType, ...]
    fields: tuple[FieldSpec, ...]
    product_name: str = "Document Classifier"
    primary_color: str = "#4f8cff"
    logo_url: str | None = None
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def type_names(self) -> list[str]:
        return [t.name for t in self.types]

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def batch_keys(self) -> list[FieldSpec]:
        return [f for f in self.fields if f.is_batch_key]

    def fields_for(self, type_name: str) -> list[FieldSpec]:
        return [f for f in self.fields if f.applies_to is None or type_name in f.applies_to]

    @property
    def branding(self) -> dict[str, str | None]:
        return {"productName": self.product_name, "primaryColor": self.primary_color, "logoUrl": self.logo_url}


def from_dict(raw: dict) -> Config:
    """A configuration from its JSON object; raises ValueError if types are missing or fields are no list."""
    types, fields = raw.get("documentTypes"), raw.get("fields")
    if not isinstance(types, list) or not types:
        raise ValueError("documentTypes must be a list that isn't empty")
    if not isinstance(fields, list):
        raise ValueError("fields must be a list")
    return Config(
        types=tuple(DocType(t["name"], tuple(t.get("keywords") or ()), 5 if t.get("keywordWeight") is None else t["keywordWeight"], t.get("description", "")) for t in types),
        fields=tuple(
            FieldSpec(f["name"], f["extractor"], tuple(f.get("labels") or ()), None if f.get("appliesTo") is None else tuple(f["appliesTo"]), bool(f.get("isBatchKey")), f.get("description", ""))
            for f in fields
        ),
        product_name=raw.get("productName") or Config.product_name,
        primary_color=raw.get("primaryColor") or Config.primary_color,
        logo_url=raw.get("logoUrl"),
    )


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return from_dict(json.load(f))


def default() -> Config:
    """The shipped configuration (fixed values)."""
    paid, every = ("Invoice", "Transaction Record", "Receipt"), ("Invoice", "Purchase Order", "Transaction Record", "Receipt")
    return Config(
        types=(
            DocType("Invoice", ("Tax Invoice", "Commercial Invoice", "Invoice To", "Bill To", "Total Due", "Amount Due", "Invoice No", "GSTIN"), 5),
            DocType("Purchase Order", ("Purchase Order", "PO No", "P.O.", "Order Date", "Proforma Invoice", "Vendor"), 5),
            DocType("Transaction Record", ("Transaction ID", "Transaction Date", "Statement", "Account Number", "Debit", "Credit", "Payment Reference", "Balance"), 5),
            DocType("Receipt", ("Receipt No", "Receipt Number", "Paid", "Payment Received", "Amount Paid", "Cash Receipt"), 4),
            DocType("Unknown", (), 0),
        ),
        fields=(
            FieldSpec(
                "documentNumber", "labeledId",
                ("Invoice No", "Invoice Number", "Inv No", "Inv #", "Receipt No", "Receipt Number", "Transaction ID", "Transaction No", "Bill No", "Reference No", "Ref No"),
                paid, True,
            ),
            FieldSpec("referenceNumber", "labeledId", ("PO No", "P.O. Number", "PO Ref", "Purchase Order No", "Purchase Order Number", "Order No"), ("Invoice", "Purchase Order"), True),
            FieldSpec("companyName", "company", (), every),
            FieldSpec("address", "address", (), every),
            FieldSpec("date", "date", ("Invoice Date", "Transaction Date", "Order Date", "Receipt Date", "Date"), every),
            FieldSpec("amount", "amount", ("Grand Total", "Total Due", "Amount Due", "Amount Paid", "Total Amount", "Net Payable", "Total"), paid),
        ),
    )
