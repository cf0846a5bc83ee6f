"""The nested ticket: a bet owns legs, a leg may own child legs (one level)."""

LEAF = "entities:array<string>,entity_type:string,market:string,target:string,ou:string,odds:int,actual:string,result:string"
LEG = f"{LEAF},is_group_leg:boolean,children:array<struct<{LEAF}>>"
BET = (
    "id string, book string, bet_id string, placed_at timestamp, settled_at timestamp, bet_type string, market_category string, sport string, description string, "
    f"name string, odds int, stake decimal(18,2), payout decimal(18,2), result string, type string, line string, ou string, legs array<struct<{LEG}>>, tail string, raw string, is_live boolean, is_sample boolean"
)
#: Version of the stored state.
STATE_VERSION = 1
