"""Fixed dimensions of the data model, as plain values."""

from __future__ import annotations

# Field states; only the firm ones may feed totals and identities.
FIELD_STATES = ("automatico_alta", "verificado", "corregido", "pendiente_baja", "conflicto", "no_revisado", "ilegible", "ausente")
FIRM_STATES = ("automatico_alta", "verificado", "corregido")
HUMAN_STATES = ("verificado", "corregido")
# Why a field has no value.
NULL_REASONS = ("ilegible", "ausente", "ambiguo", "conflicto", "manuscrito")
# Fields of a contract.
FIELDS = ("nombre", "documento", "monto", "fecha_inicio", "fecha_fin")
# Stages of a purchase, in order.
STAGES = ("pedido", "presupuesto", "oferta", "adjudicacion", "orden_compra", "remito", "factura", "orden_pago")
# Page classes by family; others belong to none.
FAMILIES = {
    "contract": ("contrato_obra", "contrato_personal", "contrato_locacion"),
    "voucher": ("factura", "recibo", "remito"),
    "act": ("decreto", "resolucion", "rendicion"),
}
# Reading routes, best first.
ROUTES = ("nativo", "ocr_a", "ocr_b")


def sql_list(values: tuple[str, ...]) -> str:
    """The values as a SQL list."""
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
