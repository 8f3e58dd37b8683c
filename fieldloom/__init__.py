"""Set-at-a-time form matching, use quotas and resume documents on Spark."""
