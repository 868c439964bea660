"""Schemas of raw inputs."""

RAW_LISTING = "vendor_id string, vendor_sku string, url string, title_raw string, price_ils string, in_stock boolean, category_guess string, vendor_meta string, scraped_at string"
LEDGER = "products array<struct<product_id:string,canonical_name:string,category:string,brand:string,model:string,attributes:map<string,string>,listing_keys:array<string>>>, blocked_pairs array<array<string>>"
LABELS = "kind string, id string, attr string, value string"
