"""Fixed values the analyses depend on.

FIXED VALUES: these lists and codes must equal the ones used by the original
reports for results to agree.  They are kept as plain text in their natural
order.  One list in the original misspells a state (it has "OregCenon");
the correctly spelt list is used here.
"""

# Cancellation reason groups.
VOLUNTARY_REASONS = ["VOL_PARTNER", "VOL_CUSTOMER"]
INVOLUNTARY_REASONS = ["INVOL_UNPAID", "INVOL_PARTNER", "INVOL_NO_MOP", "INVOL_FRAUD_SUSPICION"]

# Issuer fraud report reason codes -> text.  Codes not listed pass through.
FRAUD_REASONS = {
    "6": "TC40_Fraudulent_Use",
    "randomenotestokeep": "TC40_Fraudulent_Use",
    "1": "TC40_Card_Stolen",
    "2": "TC40_Card_Not_Received",
    "3": "TC40_Fraudulent_Application",
    "4": "TC40_Issuer_Reported_Counterfeit",
    "5": "TC40_ATO",
    "7": "TC40_Issuers_Clearinghouse_Service",
    "9": "TC40_Acquirer_reported_counterfeit",
}

# Subdivision name -> region, anything else -> "Other".
SUBDIVISION_REGIONS = {
    "Northeast": [
        "Connecticut", "Vermont", "Virginia", "Ohio", "New Hampshire", "Rhode Island", "New Jersey",
        "District Of Columbia", "Maryland", "Maine", "Massachusetts", "Pennsylvania", "New York",
        "North Carolina", "West Virginia", "Delaware",
    ],
    "West": [
        "Oregon", "Nevada", "Texas", "Kansas", "Minnesota", "Arizona", "Colorado", "Utah", "Missouri",
        "Oklahoma", "New Mexico", "Nebraska", "California", "Washington", "Alaska", "Hawaii", "Idaho",
        "Iowa", "Montana", "North Dakota", "South Dakota", "Wisconsin", "Wyoming",
    ],
}
SUBDIVISION_DEFAULT = "Other"

# State, state code or market label -> market region, anything else -> "missing".
MARKET_REGIONS = {
    "NorthEast": [
        "Baltimore, MD", "Boston et al, MA-NH", "Connecticut", "CT", "DC", "DE", "Delaware",
        "District Of Columbia", "Harrisburg et al, PA", "Hartford & New Haven, CT", "MA", "Maine",
        "Maryland", "Massachusetts", "MB", "MD", "ME", "New Hampshire", "New Jersey", "New York",
        "New York, NY", "NH", "NJ", "NY", "OH", "Ohio", "PA", "Pennsylvania", "Philadelphia, PA",
        "Pittsburgh, PA", "Providence et al, RI-MA", "Rhode Island", "RI", "Richmond-Petersburg, VA",
        "Salisbury, MD", "Springfield-Holyoke, MA", "VA", "Vermont", "Virginia", "VT",
        "Washington et al, DC-MD", "Wilkes Barre et al, PA",
    ],
    "SouthEast": [
        "Atlanta, GA", "Augusta-Aiken, GA-SC", "Charleston, SC", "FL", "Florida", "Ft. Myers-Naples, FL",
        "GA", "Georgia", "Jacksonville, FL", "Miami-Ft. Lauderdale, FL", "Mobile et al, AL-FL", "NC",
        "North Carolina", "Orlando et al, FL", "Savannah, GA", "SC", "South Carolina", "Tampa et al, FL",
        "W. Palm Beach et al, FL",
    ],
    "Central": [
        "AL", "Alabama", "AR", "Arizona", "Arkansas", "AZ", "Birmingham et al, AL", "Chattanooga, TN",
        "Chicago, IL", "CO", "Colorado", "Detroit, MI", "Huntsville et al, AL", "IA", "ID", "IL",
        "Illinois", "IN", "Indiana", "Indianapolis, IN", "Iowa", "Kansas", "Kentucky", "Knoxville, TN",
        "KS", "KY", "LA", "LAL", "Lansing, MI", "Little Rock et al, AR", "Louisiana", "LUN",
        "Memphis, TN", "MI", "Michigan", "Minnesota", "Mississippi", "Missouri", "MN", "MO", "Montana",
        "MS", "MT", "NA", "Nashville, TN", "ND", "NE", "Nebraska", "Nevada", "New Mexico", "NM", "NP",
        "NV", "OK", "Oklahoma", "SD", "South Dakota", "Tennessee", "Texas", "TN", "TNN", "TX", "UT",
        "Utah", "West Virginia", "Wheeling et al, WV-OH", "WI", "Wisconsin", "WSA", "WV", "WY", "Wyoming",
    ],
    "West": ["AK", "Alaska", "CA", "California", "Hawaii", "HI", "OR", "Oregon", "WA", "Washington"],
}
MARKET_DEFAULT = "missing"

# Issuers kept by the chargeback and refund comparisons.
FOCUS_ISSUERS = ["BANK OF AMERICA", "WELLS FARGO"]

# Days-in-subscription histogram: values above the cap go to the overflow bucket.
HISTOGRAM_CAP = 31
HISTOGRAM_OVERFLOW = 999

# A play counts as qualified from this many seconds on.
QUALIFIED_PLAY_SECS = 360
