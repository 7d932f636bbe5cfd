"""Fixed table schemas, their keys and their partition layouts.

Identifiers and daily counts are declared as BIGINT and measures as
DECIMAL(18,5). Both are wider than the INTEGER and NUMERIC(15,5) of the source
system but cost the same eight bytes, and a narrower Parquet file still reads
under the wider schema.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

MEASURE = DecimalType(18, 5)

_TYPES = {
    "id": LongType(),
    "count": LongType(),
    "flag": BooleanType(),
    "int": IntegerType(),
    "text": StringType(),
    "date": DateType(),
    "time": TimestampType(),
    "measure": MEASURE,
    "weight": DecimalType(10, 5),
    "area": DecimalType(10, 3),
    "budget": DecimalType(15, 2),
}


def _table(spec: str) -> StructType:
    fields = []
    for line in spec.strip().splitlines():
        kind, names = line.split(":")
        fields += [StructField(name, _TYPES[kind.strip()]) for name in names.split()]
    return StructType(fields)


# --- fixed values: column names and order of the four source tables ---------
ITEMS = _table("""
    id: id
    time: created_date updated_date
    int: synccounter syncflag deleted
    text: pcode description description_diacritic name short_description1 short_description2
    int: type status
    text: external_code barcode barcode_type
    int: stock_management saleprice_management
    text: saleprice_range
    int: has_variants
    text: product_category product_type accounting_code obs info_ingredients info_nutrition long_description tags
    weight: sale_markup liquid_weight gross_weight
    int: valid_period valid_open purchases_exp_date sync_status
    int: accounting_group_id created_by_id default_tax_type_id default_unit_id extension_data_id
    int: family_id family_pos_id generic_item_id group_id intrastat_nc_id intrastat_region_id
    int: logistics_unit_id origin_country_id parent_item_id property_id purchase_unit_id stock_unit_id
    int: updated_by_id loyalty_campaign_id exclude_from_sales
""")

STORES = _table("""
    id: id
    time: created_date updated_date
    int: deleted
    text: name code external_code sector accounting_code
    int: status
    text: latitude longitude
    area: floor_area
    text: address postal_code location
    int: inherit_address
    text: phone fax mobilephone email schedule obs store_ip
    budget: year_budget month_budget
    text: sales_prices_ranges pos_sw_type
    int: sync_enabled
    time: sync_enabled_date sync_disabled_date
    text: sync_conf_op contacts_responsible
    int: clapp_available
    text: email_to_display contact_to_display suppliers_channels
    int: company_id country_id created_by_id extension_data_id intrastat_region_id language_id
    int: location_repository_document_id repository_document_id sale_struct_id tax_region_id type_id updated_by_id
    text: timezone online_store_config work_time_periods
    int: sales_or_persons_per_employee
""")

STORE_DAYS = _table("""
    id: store_id
    date: date
    time: last_sale
    count: nr_sales nr_persons
    measure: total_quantity total_net total_doc
    count: nr_credits
    measure: credits_total_quantity credits_total_net credits_total_doc
    measure: waste_total_net unknown_break_total_net acc_expenses_total_net acc_credits_total_net
    measure: total_doc_excluded total_net_excluded total_discount
""")

ITEM_DAYS = _table("""
    id: item_id
    date: date
    measure: total_quantity total_net total_price self_expenditure_total_quantity
    measure: latest_price_cost price_average_cost
    id: store_id
    measure: total_discount
""")

#: sums of sales lines that daily facts are rolled up from, as whole numbers of the
#: smallest unit (see `daytally.sources.transactions.SUMS`): one row per order, store
#: and day, or per item, store and day, and delivery
ORDER_PARTS = _table("""
    id: store_id
    date: date
    id: order_id customer_id
    flag: returned
    count: total_quantity total_net total_doc credits_total_net total_discount
""")

ITEM_PARTS = _table("""
    id: item_id store_id
    date: date
    count: total_quantity total_net total_price total_discount
""")

TABLES = {
    "stores": STORES,
    "items": ITEMS,
    "da_stores_date": STORE_DAYS,
    "da_items_stores_date": ITEM_DAYS,
}

#: what a stored lake can hold: the four tables, rows that no date range takes, and parts
LAKE_TABLES = TABLES | {
    "rejected_da_stores_date": STORE_DAYS,
    "rejected_da_items_stores_date": ITEM_DAYS,
    "order_parts": ORDER_PARTS,
    "item_parts": ITEM_PARTS,
}

KEYS = {
    "stores": ["id"],
    "items": ["id"],
    "da_stores_date": ["store_id", "date"],
    "da_items_stores_date": ["item_id", "store_id", "date"],
}


@dataclass(frozen=True)
class Layout:
    """Half-open date ranges by year or month, with an open-ended past range."""

    table: str
    unit: str  # "year" or "month"
    first_year: int
    last_year: int

    @property
    def columns(self) -> list[str]:
        return ["year", "month"] if self.unit == "month" else ["year"]

    @property
    def upper_bound(self) -> date:
        return date(self.last_year + 1, 1, 1)

    def partition_name(self, day: Column) -> Column:
        """Name of the range a day falls in; NULL when no range takes it."""
        stamp = F.date_format(day, "yyyyMM" if self.unit == "month" else "yyyy")
        return (
            F.when(day < F.lit(date(self.first_year, 1, 1)), F.lit(f"{self.table}_ppast"))
            .when(day < F.lit(self.upper_bound), F.concat(F.lit(f"{self.table}_p"), stamp))
        )

    def accepts(self, day: Column) -> Column:
        return F.coalesce(day < F.lit(self.upper_bound), F.lit(False))


LAYOUTS = {
    "da_stores_date": Layout("da_stores_date", "year", 2019, 2026),
    "da_items_stores_date": Layout("da_items_stores_date", "month", 2020, 2026),
}
