"""Card-transaction behaviour features, counterparty exposure and ranked risk scoring on Spark."""
