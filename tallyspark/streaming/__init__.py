"""Change subscriptions and live views."""
