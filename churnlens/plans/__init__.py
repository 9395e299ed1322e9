"""The analyses: one DataFrame function per report, parameterised.

cohorts   signup cohorts, inactivity, outcome, main device, exposure
partners  partner retention, cancel reasons, bundles, rejoin cohorts
geo       IP geo, postal codes near signup, bundle regions, missing sources
payments  fraud reports, chargeback cube, approved vs chargebacks / refunds
registry  every analysis applied to the driver tables (``queries()``)
"""
