"""Small dimensions of an audit: success criteria, severities, issue types. All of a fixed size, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The success criteria of WCAG 2.1 with their levels.
CRITERIA = """
1.1.1 A Non-text Content
1.2.1 A Audio-only and Video-only (Prerecorded)
1.2.2 A Captions (Prerecorded)
1.2.3 A Audio Description or Media Alternative
1.2.4 AA Captions (Live)
1.2.5 AA Audio Description
1.2.6 AAA Sign Language
1.2.7 AAA Extended Audio Description
1.2.8 AAA Media Alternative
1.2.9 AAA Audio-only (Live)
1.3.1 A Info and Relationships
1.3.2 A Meaningful Sequence
1.3.3 A Sensory Characteristics
1.3.4 AA Orientation
1.3.5 AA Identify Input Purpose
1.3.6 AAA Identify Purpose
1.4.1 A Use of Color
1.4.2 A Audio Control
1.4.3 AA Contrast (Minimum)
1.4.4 AA Resize Text
1.4.5 AA Images of Text
1.4.6 AAA Contrast (Enhanced)
1.4.7 AAA Low or No Background Audio
1.4.8 AAA Visual Presentation
1.4.9 AAA Images of Text (No Exception)
1.4.10 AA Reflow
1.4.11 AA Non-text Contrast
1.4.12 AA Text Spacing
1.4.13 AA Content on Hover or Focus
2.1.1 A Keyboard
2.1.2 A No Keyboard Trap
2.1.3 AAA Keyboard (No Exception)
2.1.4 A Character Key Shortcuts
2.2.1 A Timing Adjustable
2.2.2 A Pause, Stop, Hide
2.2.3 AAA No Timing
2.2.4 AAA Interruptions
2.2.5 AAA Re-authenticating
2.2.6 AAA Timeouts
2.3.1 A Three Flashes or Below Threshold
2.3.2 AAA Three Flashes
2.3.3 AAA Animation from Interactions
2.4.1 A Bypass Blocks
2.4.2 A Page Titled
2.4.3 A Focus Order
2.4.4 A Link Purpose (In Context)
2.4.5 AA Multiple Ways
2.4.6 AA Headings and Labels
2.4.7 AA Focus Visible
2.4.8 AAA Location
2.4.9 AAA Link Purpose (Link Only)
2.4.10 AAA Section Headings
2.5.1 A Pointer Gestures
2.5.2 A Pointer Cancellation
2.5.3 A Label in Name
2.5.4 A Motion Actuation
2.5.5 AAA Target Size
2.5.6 AAA Concurrent Input Mechanisms
3.1.1 A Language of Page
3.1.2 AA Language of Parts
3.1.3 AAA Unusual Words
3.1.4 AAA Abbreviations
3.1.5 AAA Reading Level
3.1.6 AAA Pronunciation
3.2.1 A On Focus
3.2.2 A On Input
3.2.3 AA Consistent Navigation
3.2.4 AA Consistent Identification
3.2.5 AAA Change on Request
3.3.1 A Error Identification
3.3.2 A Labels or Instructions
3.3.3 AA Error Suggestion
3.3.4 AA Error Prevention (Legal, Financial, Data)
3.3.5 AAA Help
3.3.6 AAA Error Prevention (All)
4.1.1 A Parsing
4.1.2 A Name, Role, Value
4.1.3 AA Status Messages
"""
# Levels of severity.
SEVERITIES = {"critical": 3, "major": 2, "minor": 1, "info": 0}
# Registered issue types with criterion, severity, kind of remediation and elements.
ISSUE_TYPES = """
missing-alt-text 1.1.1 critical attribute img
generic-alt-text 1.1.1 major attribute img
decorative-image-with-alt 1.1.1 minor attribute img
improper-heading-structure 1.3.1 major structure h1,h2,h3,h4,h5,h6
missing-document-language 3.1.1 critical attribute html
missing-page-title 2.4.2 major element title
missing-main-landmark 1.3.1 major attribute main
insufficient-color-contrast 1.4.3 major style p,span,a
generic-link-text 2.4.4 major content a
empty-link 2.4.4 critical content a
missing-skip-link 2.4.1 major element body
"""
# Issue types an audit reports, by what remediation makes of them as it stands (see `dispatch_outcome`).
WORKS = (
    "table-missing-headers", "table-missing-scope", "table-missing-caption", "table-missing-thead", "table-missing-tbody", "table-irregular-headers", "table-missing-headers-id",
    "generic-alt-text", "no-h1", "no-headings", "missing-main-landmark", "missing-navigation-landmark", "missing-header-landmark", "missing-footer-landmark", "missing-skip-link",
)
FAILS_AT_CALL = ("insufficient-color-contrast",)
TARGET_NOT_FOUND = ("skipped-heading-level", "empty-heading")


def criteria(spark: SparkSession) -> DataFrame:
    rows = [tuple(x.split(" ", 2)) for x in CRITERIA.strip().split("\n")]
    return spark.createDataFrame([(c, n, lv) for c, lv, n in rows], "criterion string, criterion_name string, criterion_level string")


def issue_types(spark: SparkSession) -> DataFrame:
    rows = [x.split(" ") for x in ISSUE_TYPES.strip().split("\n")]
    return spark.createDataFrame([(a, b, c, d, e.split(",")) for a, b, c, d, e in rows], "type string, criterion string, severity string, remediation_type string, element_types array<string>")


def severity_level(c: Column, unknown: int = 0) -> Column:
    """critical 3, major 2, minor 1, info 0; anything else `unknown`."""
    out = F.lit(unknown)
    for name, level in SEVERITIES.items():
        out = F.when(c == name, level).otherwise(out)
    return out


def dispatch_outcome(c: Column) -> Column:
    """What happens when an issue of a type is remediated by name: works, fails at the call, finds no target, or is skipped."""
    return (
        F.when(c.isin(*WORKS), "works").when(c.isin(*FAILS_AT_CALL), "fails_at_call").when(c.isin(*TARGET_NOT_FOUND), "target_not_found").otherwise("skipped_no_key")
    )


def types_of_element(types: DataFrame, element: str) -> DataFrame:
    return types.where(F.array_contains("element_types", element))
