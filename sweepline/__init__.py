"""sweepline: weather-radar volume analytics as plain DataFrame functions on Spark."""
