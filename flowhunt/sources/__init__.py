"""Readers and writers for packets, flows, alerts, captures and models."""
