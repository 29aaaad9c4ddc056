"""Rule-based eligibility logic, scoring statistics and text preparation as Spark jobs."""
