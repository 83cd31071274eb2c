"""Parameters of the registered reports on the test views.

The reference's windows are in 2012; the test views cover January 2024 - January 2025
(stretched event time), so the same calendar windows are taken in 2024. The reference's
referer literal does not occur in the test views; a referer that does is used instead.
"""

# Report parameters.
GSEARCH = "gsearch"
BRAND_CAMPAIGNS = ("brand", "nonbrand")
NONBRAND = "nonbrand"
NONBRAND_LIKE = "%nonbrand%"
SESSIONS_REFERER_NOT_LIKE = "%brand%"
ORDERS_REFERER_NOT_LIKE = "%nonbrand%"
CONVERSION_WINDOW = ("2024-01-01", "2024-08-31")      # BETWEEN, reference: 2012-01-01 .. 2012-08-31
FUNNEL_WINDOW = ("2024-06-19", "2024-07-28")          # open range, reference: Jun 19 - Jul 28 2012
BILLING_WINDOW = ("2024-09-10", "2024-11-10")         # open range, reference: Sep 10 - Nov 10 2012
REFERER = "https://brand.example"                      # reference: 'g search lander test'
REPORT_LIMIT = 1000
