"""Rule parameters used with the test tables (the production defaults flag nothing there:
the largest order total is below 500,000 and the sanctioned codes do not occur)."""

from txmon.operators.rules import RuleConfig

# Test nations standing in for sanctioned countries.
TEST_COUNTRIES = ("NATION_3", "NATION_7", "NATION_11", "NATION_19")

TXN_RULES = RuleConfig(high_amount=450_000.0, sanctioned=TEST_COUNTRIES)
EVENT_RULES = RuleConfig(high_amount=200.0, sanctioned=TEST_COUNTRIES)

# Dormancy on txn: per customer account, gap >= 180 days and amount >= 400,000.
DORMANT_GAP_SECONDS = 180 * 86400
DORMANT_MIN_AMOUNT = 400_000.0
# Dormancy on events: per user, gap >= 24 h and value >= 100.
EVENT_DORMANT_GAP_SECONDS = 24 * 3600
EVENT_DORMANT_MIN_VALUE = 100.0
