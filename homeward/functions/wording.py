"""Every sentence an explanation can contain, in its reported form."""

# Lower bounds of the five description bands; the last band has none.
BANDS = [0.9, 0.8, 0.7, 0.6]

# One description per band, best first.
DESCRIPTIONS = {
    "face_similarity": [
        "Excellent facial similarity - very strong match",
        "High facial similarity - strong match",
        "Good facial similarity - moderate match",
        "Fair facial similarity - weak match",
        "Low facial similarity - poor match",
    ],
    "metadata_consistency": [
        "Excellent metadata alignment - all details match well",
        "High metadata consistency - most details align",
        "Good metadata consistency - key details match",
        "Fair metadata consistency - some details match",
        "Low metadata consistency - few details align",
    ],
    "age_plausibility": [
        "Age progression is highly plausible",
        "Age progression is very plausible",
        "Age progression is plausible",
        "Age progression is somewhat plausible",
        "Age progression is questionable",
    ],
    "location_proximity": [
        "Locations are very close or identical",
        "Locations are in close proximity",
        "Locations are reasonably close",
        "Locations are somewhat distant",
        "Locations are far apart",
    ],
    "distinctive_features": [
        "Distinctive features match excellently",
        "Distinctive features match well",
        "Some distinctive features match",
        "Few distinctive features match",
        "No distinctive features match or insufficient data",
    ],
}

# From which factor value on a sentence is used. "high" and "low" bound the
# reasons, "support" the additions to the summary, "check" the extra recommendations.
FACE_STRONG, FACE_MODERATE = 0.8, 0.6
HIGH_LOW = {
    "age": (0.8, 0.5),
    "location": (0.7, 0.3),
    "features": (0.7, 0.3),
}
SUPPORT_FROM = 0.8
CHECK_BELOW = {"face": 0.6, "age": 0.5, "location": 0.3}

# A face above the first bound with metadata below the second is suspicious.
ALERTS = {"warning": (0.95, 0.3), "caution": (0.90, 0.4)}

# Reasons.
FACE_REASONS = {
    "strong": "Strong facial similarity (%.2f)",
    "moderate": "Moderate facial similarity (%.2f)",
    "weak": "Weak facial similarity (%.2f)",
}
REASONS = {
    "age_high": "Age progression is highly consistent",
    "age_low": "Age progression raises concerns",
    "location_high": "Locations are geographically consistent",
    "location_low": "Locations are geographically distant",
    "features_high": "Distinctive features support the match",
    "features_low": "Distinctive features do not align",
    "gender_same": "Gender information matches",
    "gender_conflict": "Gender information conflicts",
    "warning": (
        "⚠️ WARNING: Very high face similarity but very low metadata consistency"
        " - possible false positive"
    ),
    "caution": (
        "⚠️ CAUTION: High face similarity but low metadata consistency - verify carefully"
    ),
}

# Summaries.
SUMMARIES = {
    "VERY_HIGH": (
        "This is a very strong potential match with excellent alignment across multiple factors."
    ),
    "HIGH": "This is a strong potential match with good alignment across most factors.",
    "MEDIUM": (
        "This is a moderate potential match with reasonable alignment in key factors."
    ),
    "LOW": "This is a weak potential match with limited alignment across factors.",
    "VERY_LOW": "This is a very weak potential match with poor alignment across factors.",
}
SUMMARY_SUPPORT = {
    "both": " Both facial features and age progression strongly support this match.",
    "face": " Facial features strongly support this match.",
    "age": " Age progression strongly supports this match.",
}
SUMMARY_ALERT = {
    "warning": (
        " ⚠️ WARNING: Despite high face similarity, metadata does not align well"
        " - verify carefully to avoid false positive."
    ),
    "caution": (
        " ⚠️ CAUTION: High face similarity but metadata inconsistencies detected"
        " - additional verification recommended."
    ),
}

# Recommendations.
RECOMMENDATIONS = {
    "VERY_HIGH": [
        "Immediately contact the relevant authorities",
        "Prepare for potential family notification",
        "Gather additional verification materials",
    ],
    "HIGH": [
        "Contact authorities for further investigation",
        "Collect additional identifying information",
        "Consider DNA testing if possible",
    ],
    "MEDIUM": [
        "Conduct additional verification steps",
        "Gather more recent photos if available",
        "Cross-reference with other databases",
    ],
    "LOW": [
        "Treat as preliminary lead requiring verification",
        "Collect more detailed information",
        "Consider expanding search parameters",
    ],
    "VERY_LOW": [
        "Consider this a weak lead",
        "Review search parameters",
        "Focus on higher-confidence matches",
    ],
}
EXTRA_RECOMMENDATIONS = {
    "face": "Consider using additional photos for comparison",
    "age": "Verify age information and timeline details",
    "location": "Investigate possible travel or relocation patterns",
}
