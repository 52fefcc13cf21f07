"""Which field a label on a form stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drayage.functions import shapes as S

# Other names of fields, in the order in which they are tried.
FIELD_ALIASES = {
    "bill_number": "bill_number purchase_order po_number bill-number bill_no billno bill_num job_number job_no jobnumber manifest_number manifest_no bol_number bol bill_of_lading billoflading freight_bill_number lr_no waybill carta_de_porte conocimiento_de_embarque guia numero_de_guia",
    "carrier": "carrier carrier_name hauler trucking_company transporter transportista porteador",
    "invoice_number": "invoice_number invoice_id invoice_no invoice inv_number inv_no inv",
    "bill_date": "bill_date invoice_date ship_date shipping_date date dated",
    "consignor": "consignor shipper shipper_name consignor_name sender from_party billed_from remitente expedidor cargador",
    "consignee": "consignee receiver receiver_name consignee_name recipient to_party billed_to destinatario consignatario",
    "origin": "origin place_of_receipt pickup_location origin_city from_location origen lugar_de_carga point_of_origin pointoforigin",
    "destination": "destination place_of_delivery delivery_location dest_city to_location destino lugar_de_descarga point_of_destination pointofdestination",
    "commodity_description": "commodity_description commodity cargo_description goods_description description_of_goods description item_description",
    "quantity": "quantity no_of_packages packages units qty total_quantity",
    "weight": "weight gross_weight total_weight net_weight wt charged_weight",
    "freight_amount": "freight_amount freight_charges freight_charge freight_rate freight_cost",
    "fuel_surcharge": "fuel_surcharge fuel_surcharge_amount fuel_charge fuel",
    "handling_charge": "handling_charge handling_amount handling",
    "total_amount": "total_amount total total_charge net_amount invoice_total amount_due grand_total",
    "vehicle_number": "vehicle_number vehicle_no truck_number truck_no trailer_no container_no vehicle_id lorry_no",
    "driver_name": "driver_name driver operator driver_id",
    "pickup_time": "pickup_time pickup_datetime time_in gate_in",
    "delivery_time": "delivery_time delivery_datetime time_out gate_out",
    "special_instructions": "special_instructions instructions remarks notes handling_instructions",
    "driver_signature": "driver_signature driver_sig",
    "consignee_signature": "consignee_signature receiver_signature consignee_sig",
    "received_datetime": "received_datetime received_date delivered_at",
}
#: (alias, field, place in the order).
ALIAS_ROWS = [(a, f, i) for i, (a, f) in enumerate((a, f) for f, names in FIELD_ALIASES.items() for a in names.split())]


def field_of_label(c: Column) -> Column:
    """The field a label names: itself, else its alias, else the first alias that holds it or that it holds; null if none."""
    rows = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(f).alias("field")) for a, f, _ in ALIAS_ROWS])
    first = lambda test: F.get(F.filter(rows, test), F.lit(0))["field"]

    def of(key: Column) -> Column:
        near = first(lambda r: F.contains(key, r["alias"]) | F.contains(r["alias"], key))
        return F.when(key == "", None).when(key.isin(S.SCHEMA_FIELDS), key).otherwise(F.coalesce(first(lambda r: r["alias"] == key), near))

    return S.let(S.label_key(c), of)
