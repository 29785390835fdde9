"""Whole jobs: enrolment, searches, scoring and reports."""
