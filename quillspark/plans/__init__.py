"""Whole queries: over the standard tables, over Go trees and over git history."""
